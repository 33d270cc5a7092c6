"""Tables in Markdown, in expressions and windows only: (doc_id, text) -> cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_label, find_label


def is_separator(line: Column) -> Column:
    """At least two cells of dashes and colons only."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    cells = F.split(inner, r"\|")
    return (F.size(cells) >= 2) & F.forall(cells, lambda c: F.trim(c).rlike(r"^:?-+:?$"))


def scan_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, page_idx, label, row_idx, col_idx, text): runs of lines that begin and end with a pipe.

    Separator lines go. A table takes the last label above it that no table has taken; ``<!-- Page N -->`` sets the
    zero-based page. Tables of more than 30 columns with less than 30 % filled are fragments and go.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    piped = F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") >= 2)
    page = F.nullif(F.regexp_extract("line", r"(?i)<!--\s*Page\s+([0-9]+)\s*-->", 1), F.lit("")).cast("int") - 1
    rows = lines.withColumn("piped", piped).withColumn("starts", (F.col("piped") & ~F.coalesce(F.lag("piped").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("table_no", F.sum("starts").over(w)).withColumn("page_idx", F.coalesce(F.last(page, ignorenulls=True).over(w), F.lit(0)))
    label = F.when(~F.col("piped"), F.nullif(canonical_label(find_label(F.col("line"))), F.lit("")))
    # a label counts until the table below it begins: it has the number of the table before it
    own = F.when(F.nullif(label, F.lit("")).isNotNull(), F.struct(label.alias("label"), "table_no"))
    rows = rows.withColumn("own", own).withColumn("last", F.last("own", ignorenulls=True).over(w))
    label = F.when(F.col("last.table_no") == F.col("table_no") - 1, F.col("last.label"))
    body = rows.where(F.col("piped") & ~is_separator(F.col("line")))
    texts = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    body = body.select("doc_id", "table_no", "page_idx", "line_no", F.coalesce(label, F.lit("")).alias("label"), texts.alias("texts"))
    # rows are numbered and tables judged before rows become cells: a document's lines are sorted, never joined again
    table = Window.partitionBy("doc_id", "table_no")
    body = body.withColumn("row_idx", F.row_number().over(table.orderBy("line_no")) - 1).withColumn("filled", F.size(F.filter("texts", lambda x: x != "")))
    body = body.withColumn("cols", F.max(F.size("texts")).over(table)).withColumn("places", F.col("cols") * F.count(F.lit(1)).over(table)).withColumn("filled", F.sum("filled").over(table))
    sound = body.where(~((F.col("cols") > 30) & (F.col("filled") / F.col("places") < 0.30)))
    return sound.select("doc_id", "table_no", "page_idx", "label", "row_idx", F.posexplode("texts").alias("col_idx", "text"))


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text) of texts with ``<!-- Page N -->`` marks; text before the first mark is page 0."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?i)(?=<!--\s*Page\s+[0-9]+\s*-->)")
    rows = docs.select("doc_id", F.explode(parts).alias("part"))
    page = F.coalesce(F.nullif(F.regexp_extract("part", r"(?i)^<!--\s*Page\s+([0-9]+)\s*-->", 1), F.lit("")).cast("int") - 1, F.lit(0))
    text = F.regexp_replace(F.regexp_replace("part", r"(?i)^<!--\s*Page\s+[0-9]+\s*-->", ""), r"^\s+|\s+$", "")
    return rows.select("doc_id", page.alias("page_idx"), text.alias("text")).where("text <> ''")


def has_table(text: Column) -> Column:
    """An HTML table, or a row of pipes with a separator below it."""
    return F.lower(text).contains("<table") | text.rlike(r"(?m)^\s*\|.*\|\s*\n\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
