"""Declared against extracted: completeness, and the check of numbers against the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_tables(declared: DataFrame, extracted: DataFrame) -> DataFrame:
    """Declarations (doc_id, label, …) without a table of that label: an anti join on the label."""
    return declared.join(extracted.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")


def completeness(declared: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, n_declared, n_extracted, recall): recall is capped at 1, and 1 where nothing was declared."""
    d = declared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_declared"))
    e = extracted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_extracted"))
    out = d.join(e, "doc_id", "full_outer").na.fill(0)
    return out.withColumn("recall", F.round(F.when(F.col("n_declared") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("n_extracted") / F.col("n_declared"))), 4))


def numeric_gate(table_numbers: DataFrame, page_numbers: DataFrame, least_precision: float = 0.70, least_recall: float = 0.50) -> DataFrame:
    """(table_id, n_table, n_page, matched, precision, recall, status): multisets of (table_id, number).

    passed, failed, or unverified where the table or the page has no numbers.
    """
    t = table_numbers.groupBy("table_id", "number").agg(F.count(F.lit(1)).alias("a"))
    p = page_numbers.groupBy("table_id", "number").agg(F.count(F.lit(1)).alias("b"))
    both = t.join(p, ["table_id", "number"], "full_outer").na.fill(0, ["a", "b"])
    out = both.groupBy("table_id").agg(F.sum("a").alias("n_table"), F.sum("b").alias("n_page"), F.sum(F.least("a", "b")).alias("matched"))
    precision, recall = F.col("matched") / F.greatest(F.lit(1), F.col("n_table")), F.col("matched") / F.greatest(F.lit(1), F.col("n_page"))
    status = F.when((F.col("n_table") == 0) | (F.col("n_page") == 0), "unverified").when((precision >= least_precision) & (recall >= least_recall), "passed").otherwise("failed")
    return out.select("table_id", "n_table", "n_page", "matched", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), status.alias("status"))


def captions_by_ordinal(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Labels for tables (doc_id, page_idx, table_idx): the t-th of a page takes its t-th caption; a page without
    captions goes on with the label before it if that is at most three pages back."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("table_idx"))
    cap = captions.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("line_no"))).select("doc_id", "page_idx", "nth", "label")
    out = tables.withColumn("nth", nth).join(cap, ["doc_id", "page_idx", "nth"], "left")
    before = Window.partitionBy("doc_id").orderBy("page_idx", "table_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("label").isNotNull(), F.struct("label", "page_idx")), ignorenulls=True).over(before)
    inherited = F.when(F.col("label").isNull() & (F.col("page_idx") - F.col("last.page_idx") <= 3), F.col("last.label"))
    return out.withColumn("last", last).select("doc_id", "page_idx", "table_idx", F.coalesce("label", inherited).alias("label"), F.coalesce(inherited.isNotNull(), F.lit(False)).alias("is_continuation"))


def references_section(lines: DataFrame) -> DataFrame:
    """Adds in_references to (doc_id, line_no, line): after a heading of references in the last 40 % of a document, until an appendix."""
    heading = F.trim("line").rlike(r"(?i)^(?:[0-9.]* *)?(?:references|bibliography|literature cited|参考文献)\s*$")
    appendix = F.trim("line").rlike(r"(?i)^(?:appendix|supplementary|附录)")
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    mark = F.when(heading & (F.col("line_no") >= 0.6 * last), F.lit(True)).when(appendix, F.lit(False))
    return lines.withColumn("in_references", F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit(False)))
