"""Code-corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with their job, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
