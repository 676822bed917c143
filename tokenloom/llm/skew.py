"""Joins of rows to a table of their groups where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Add to each row the columns of its group; ``count`` is the group's number of rows.

    Groups with more than one row in ``HOT`` are at most ``HOT`` in number, which bounds the broadcast; all others meet
    their rows in a shuffle, where no key has more than that share.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(count) * HOT > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(count) * HOT <= total), key)
    return rows.join(hot, key).unionByName(rest)
