"""Connected components of an edge table, distributed (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

MAX_ROUNDS = 60


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): component is the smallest id that can be reached; ids without an edge are absent.

    Each round is two aggregations and two joins over the edges, written to the shared folder. A vertex with very
    many edges is a skewed join key, which adaptive execution splits; its minimum is aggregated map-side.
    """
    step = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stamp = _stamp(step)
    if not stamp[0]:
        return step.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        step = materialize(small.where("u <> v").distinct(), "edges")
        before, stamp = stamp, _stamp(step)
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = step.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return step.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
