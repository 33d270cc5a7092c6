"""Joins in which one key may hold a large share of the rows.

A key is heavy if it has more than one of HEAVY parts of the left side's rows, so there are fewer than HEAVY heavy keys, whatever
the input: their list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 10_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row a key and in ``count`` the rows that ``left`` has of it.

    Heavy keys are joined by a broadcast of fewer than HEAVY rows, all others by a shuffle in which no key is heavy.
    Both sides are read twice and should be written tables.
    """
    least = max(1.0, total / HEAVY)
    heavy = F.broadcast(right.where(F.col(count) > least))
    cold = left.join(heavy.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= least), keys)
    return left.join(heavy, keys).unionByName(cold)


def heavy_copies(left: DataFrame, key: str, total: int) -> DataFrame:
    """(key, _copies): the heavy keys and how many tasks their rows are spread over; fewer than HEAVY rows."""
    least = max(1, -(-total // HEAVY))
    return left.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_copies"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, heavy: DataFrame) -> DataFrame:
    """Inner join on ``key``: a heavy key's left rows are spread by a hash of ``spread`` over copies of its right rows.

    ``heavy`` is from ``heavy_copies``; its copies sum up to 2 * HEAVY at most.
    """
    heavy = F.broadcast(heavy)
    one = F.coalesce("_copies", F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_copies")
    copied = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
