"""Joining tables that say different things about the same rows. Rows are (pair_id, row_no, key, <columns>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import merge_key


def complementary(primary: DataFrame, secondary: DataFrame, key: str, added: list[str]) -> DataFrame:
    """Primary rows with the columns that only the secondary side has, then secondary rows without a partner.

    Keys are compared in their canonical spelling. A pair (column pair_id) is refused, and its primary rows come back
    alone, if a key is empty or repeats on either side or if the sides share no key.
    """
    p, s = primary.withColumn("_k", merge_key(F.col(key))), secondary.withColumn("_k", merge_key(F.col(key)))
    stats = p.select("pair_id", "_k", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(s.select("pair_id", "_k", F.lit(0).alias("a"), F.lit(1).alias("b")))
    by_key = stats.groupBy("pair_id", "_k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    fit = by_key.groupBy("pair_id").agg((F.max("a") <= 1).alias("ua"), (F.max("b") <= 1).alias("ub"), F.max(F.col("_k") == "").alias("blank"), F.max((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))
    ok = fit.select("pair_id", (F.col("ua") & F.col("ub") & ~F.col("blank") & F.col("shared")).alias("_ok"))
    left = p.join(ok, "pair_id", "left")
    right = s.join(ok.where("_ok"), "pair_id").select("pair_id", "_k", F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in added])
    merged = left.join(right, ["pair_id", "_k"], "left")
    own = [c for c in primary.columns if c not in ("pair_id", *added)]
    kept = merged.select("pair_id", *own, *[F.coalesce(F.col(f"_{c}"), F.lit("")).alias(c) for c in added])
    alone = right.join(p.select("pair_id", "_k"), ["pair_id", "_k"], "left_anti")
    rest = alone.select("pair_id", *[F.col("_key").alias(c) if c == key else F.lit(None).cast(primary.schema[c].dataType).alias(c) for c in own], *[F.col(f"_{c}").alias(c) for c in added])
    return kept.unionByName(rest)


def horizontal(left: DataFrame, right: DataFrame, left_value: str, right_value: str) -> DataFrame:
    """Halves (pair_id, key, value) of one table side by side: full outer one to one, refused where keys repeat or are blank."""
    keys = left.select("pair_id", "key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select("pair_id", "key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    fit = keys.groupBy("pair_id", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("pair_id").agg((F.max(F.greatest("a", "b")) <= 1).alias("once"), F.max(F.trim(F.coalesce("key", F.lit(""))) == "").alias("blank"))
    good = fit.where("once and not blank").select("pair_id")
    return left.join(good, "pair_id").select("pair_id", "key", left_value).join(right.join(good, "pair_id").select("pair_id", "key", right_value), ["pair_id", "key"], "full_outer")


def conflict(cells_a: DataFrame, cells_b: DataFrame) -> DataFrame:
    """(pair_id, shared, conflicts, swaps, overlap, distinct_version) of two versions (pair_id, sample, field, value).

    Different versions: fewer than 0.4 of the samples shared, values that swap places, or at least 2 conflicts or 15 %.
    """
    both = cells_a.withColumnRenamed("value", "va").join(cells_b.withColumnRenamed("value", "vb"), ["pair_id", "sample", "field"])
    norm = lambda c: F.lower(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))))
    filled = both.select("pair_id", "field", "sample", norm(F.col("va")).alias("va"), norm(F.col("vb")).alias("vb")).where("va <> '' and vb <> ''")
    counts = filled.groupBy("pair_id").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("va") != F.col("vb")).alias("conflicts"))
    # a swap is a pair (x, y) in one row and (y, x) in another: count both directions on the unordered pair
    moved = filled.where("va <> vb").groupBy("pair_id", "field", F.least("va", "vb").alias("x"), F.greatest("va", "vb").alias("y")).agg(F.count_if(F.col("va") < F.col("vb")).alias("up"), F.count_if(F.col("va") > F.col("vb")).alias("down"))
    swaps = moved.groupBy("pair_id").agg(F.sum(F.least("up", "down")).alias("swaps"))
    names = cells_a.select("pair_id", "sample", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(cells_b.select("pair_id", "sample", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("pair_id", "sample").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    overlap = names.groupBy("pair_id").agg((F.sum(F.col("a") * F.col("b")) / F.greatest(F.lit(1), F.least(F.sum("a"), F.sum("b")))).alias("overlap"))
    out = overlap.join(counts, "pair_id", "left").join(swaps, "pair_id", "left").na.fill(0, ["shared", "conflicts", "swaps"])
    different = (F.col("overlap") < 0.4) | (F.col("swaps") > 0) | (F.col("conflicts") >= 2) | (F.col("conflicts") >= F.greatest(F.lit(0.15) * F.col("shared"), F.lit(1e-9)))
    return out.withColumn("distinct_version", different)


def match_tables(left: DataFrame, right: DataFrame, cells_left: DataFrame, cells_right: DataFrame) -> DataFrame:
    """(doc_id, left_id, right_id, how): equal labels first; of the rest, tables of a page that share enough values.

    Tables are (doc_id, id, page_idx, label), cells (id, value). A left table gets the unmatched right one that shares
    most, and keeps it if it is also that one's best.
    """
    by_label = left.alias("l").join(right.alias("r"), F.expr("l.doc_id = r.doc_id and l.label = r.label and l.label <> ''")).select(F.col("l.doc_id").alias("doc_id"), F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))
    by_label = by_label.groupBy("doc_id", "left_id").agg(F.min("right_id").alias("right_id")).groupBy("doc_id", "right_id").agg(F.min("left_id").alias("left_id"))
    rest_l = left.join(by_label.select(F.col("left_id").alias("id")), "id", "left_anti")
    rest_r = right.join(by_label.select(F.col("right_id").alias("id")), "id", "left_anti")
    a = rest_l.join(cells_left, "id").select("doc_id", "page_idx", F.col("id").alias("left_id"), "value").distinct()
    b = rest_r.join(cells_right, "id").select("doc_id", "page_idx", F.col("id").alias("right_id"), "value").distinct()
    size_a, size_b = a.groupBy("left_id").agg(F.count(F.lit(1)).alias("na")), b.groupBy("right_id").agg(F.count(F.lit(1)).alias("nb"))
    shared = a.join(b, ["doc_id", "page_idx", "value"]).groupBy("doc_id", "left_id", "right_id").agg(F.count(F.lit(1)).alias("n")).join(size_a, "left_id").join(size_b, "right_id")
    good = shared.where((F.col("n") >= 2) & (F.col("n") >= 0.25 * F.least("na", "nb")))
    best_l = good.groupBy("doc_id", "left_id").agg(F.max(F.struct("n", (-F.col("right_id")).alias("r"))).alias("b")).select("doc_id", "left_id", (-F.col("b.r")).alias("right_id"))
    best_r = good.groupBy("doc_id", "right_id").agg(F.max(F.struct("n", (-F.col("left_id")).alias("l"))).alias("b")).select("doc_id", (-F.col("b.l")).alias("left_id"), "right_id")
    mutual = best_l.join(best_r, ["doc_id", "left_id", "right_id"])
    return by_label.select("doc_id", "left_id", "right_id", F.lit("label").alias("how")).unionByName(mutual.withColumn("how", F.lit("content")))


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Upsert: of the rows of a key the last one by ``order``."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in names])
