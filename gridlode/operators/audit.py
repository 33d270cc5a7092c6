"""Scores of extracted documents and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import default_headers, fill_and_shape, footnote_rows


def table_dimensions(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, unnamed, numeric_cells, squeezed_cells, multiline_cells, sparsity, footnote_embedded, anomalies) per table."""
    s = F.trim(F.coalesce("text", F.lit("")))
    has = ~F.lower(s).isin("", "nan", "none", "-")
    number = s.rlike(r"^[<>]?[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$") | s.rlike(r"^[0-9]+(?:\.[0-9]+)? *[±~～-] *[0-9]+(?:\.[0-9]+)?$")
    parts = F.size(F.filter(F.split(s, r"\s+"), lambda t: t.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")))
    squeezed = ~number & (F.length(s) > 20) & (parts >= 2)
    by_table = cells.groupBy("table_id").agg(F.count_if(has & number).alias("numeric_cells"), F.count_if(has & squeezed).alias("squeezed_cells"), F.count_if(F.contains(F.col("text"), F.lit("\n"))).alias("multiline_cells"))
    last = cells.select("table_id", "row_idx").groupBy("table_id").agg(F.max("row_idx").alias("row_idx"))
    foot = footnote_rows(cells.join(last, ["table_id", "row_idx"], "left_semi")).select("table_id", F.col("is_note").alias("footnote_embedded"))
    out = by_table.join(default_headers(headers), "table_id", "left").join(fill_and_shape(cells).select("table_id", (1 - F.col("fill_ratio")).alias("sparsity")), "table_id").join(foot, "table_id").na.fill(False, ["unnamed"])
    return out.withColumn("anomalies", F.col("unnamed").cast("long") + (F.col("squeezed_cells") > 0).cast("long") + F.col("footnote_embedded").cast("long"))


def document_scores(documents: DataFrame) -> DataFrame:
    """Adds score and band to (…, missing, has_manifest, anomalies): 100 - min(40, 15 missing) - 10 - min(30, 5 anomalies)."""
    score = 100 - F.least(F.lit(40), 15 * F.col("missing")) - F.when(F.col("has_manifest"), 0).otherwise(10) - F.least(F.lit(30), 5 * F.col("anomalies"))
    band = F.when((F.col("score") >= 95) & (F.col("anomalies") == 0), "pass").when(F.col("score") >= 85, "high").otherwise("low")
    return documents.withColumn("score", score.cast("long")).withColumn("band", band)


def report(documents: DataFrame, by: str) -> DataFrame:
    """Counts, mean scores and bands by a column and in all (grouping sets)."""
    return documents.rollup(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("band") == "pass").alias("n_pass"), F.count_if(F.col("band") == "high").alias("n_high"),
        F.count_if(F.col("band") == "low").alias("n_low"), F.sum("missing").alias("n_missing"), F.sum("anomalies").alias("n_anomalies"),
    )


def numbering_gaps(labels: DataFrame) -> DataFrame:
    """(doc_id, chapter, missing_number): numbers (doc_id, chapter, number) that are skipped between the first and the last."""
    rows = labels.distinct()
    ahead = F.lead("number").over(Window.partitionBy("doc_id", "chapter").orderBy("number"))
    gaps = rows.withColumn("next", ahead).where("next - number > 1")
    return gaps.select("doc_id", "chapter", F.explode(F.sequence(F.col("number") + 1, F.col("next") - 1)).alias("missing_number"))


def confusion(truth: DataFrame, extracted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, n_cells, n_wrong, n_missing_rows, error_rate): sampled cells (doc_id, row_idx, col_idx, num) against extracted ones.

    A number is right within 1e-3 or ``tolerance`` of its size.
    """
    # both sides of a cell are grouped, not joined: a group needs no dealing of its own where documents are dealt already, and no second sort
    keys = ["doc_id", "row_idx", "col_idx"]
    known = F.col("doc_id").isNotNull() & F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull()
    sides = truth.select(*keys, F.struct("num").alias("t"), F.lit(None).alias("e")).unionByName(extracted.select(*keys, F.lit(None).alias("t"), F.when(known, F.struct("num")).alias("e")))
    cells = sides.groupBy(*keys).agg(F.collect_list("t").alias("wants"), F.collect_list("e").alias("gots")).where(F.size("wants") > 0)
    right = lambda want, got: F.coalesce(F.abs(got - want) <= F.greatest(F.lit(1e-3), F.lit(tolerance) * F.abs(want)), F.lit(False))
    hits = F.aggregate("wants", F.lit(0).cast("long"), lambda n, t: n + F.size(F.filter("gots", lambda e: right(t["num"], e["num"]))))
    n = F.size("wants").cast("long") * F.greatest(F.size("gots"), F.lit(1))
    rows = cells.select("doc_id", "row_idx", n.alias("n"), (n - hits).alias("wrong"), F.exists("gots", lambda e: e["num"].isNotNull()).alias("seen")).groupBy("doc_id", "row_idx").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.max("seen").alias("seen"))
    out = rows.groupBy("doc_id").agg(F.sum("n").alias("n_cells"), F.sum("wrong").alias("n_wrong"), F.count_if(~F.col("seen")).alias("n_missing_rows"))
    return out.withColumn("error_rate", F.round(F.col("n_wrong") / F.col("n_cells"), 6))
