"""Reading a crawl log table: id, ts, level, logger, message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Page size of a tail read, and rows a log keeps.
DEFAULT_TAIL = 200
MAX_TAIL = 1000
KEEP_LATEST = 3000


def tail_after(log: DataFrame, after: int = 0, limit: int = DEFAULT_TAIL) -> DataFrame:
    """The next rows after an id, in id order. The limit is held within 1 to 1000."""
    size = max(1, min(limit, MAX_TAIL))
    return log.where(F.col("id") > max(0, after)).orderBy("id").limit(size)


def next_cursor(tail: DataFrame, after: int = 0) -> DataFrame:
    """One row ``next_after``: the last id of a tail, or the given id if it is empty."""
    return tail.agg(F.coalesce(F.max("id"), F.lit(max(0, after))).alias("next_after"))


def keep_latest(log: DataFrame, n: int = KEEP_LATEST) -> DataFrame:
    """The newest ``n`` rows by id."""
    return log.orderBy(F.desc("id")).limit(n)
