"""Parameters of the registered queries, shared by the Spark side and the SQL side."""

from tokenloom.functions import codec as cd
from tokenloom.operators import bpe

SHARD_ROWS = 300
SAMPLE_PERCENT = 12
TRAIN_RATIO = 0.83
BATCH = 32
TOP = 50
EXTRA_IDS = 40
MERGES = 256
SAMPLE_MERGES = MERGES
_FIRST = len(bpe.SPECIAL_TOKENS) + cd.BASE_SIZE
SWEEP = [_FIRST + 16, _FIRST + 64, _FIRST + 128, _FIRST + 256]
MAX_LENGTH = 1536
REPORT_EVERY = 1000
STREAM_FILES = 6
