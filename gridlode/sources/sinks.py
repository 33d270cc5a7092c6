"""What leaves the engine: manifests, preview cards, column widths, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_file_name


def natural_key(label: Column) -> Column:
    """Numbers inside a label sort as numbers."""
    return F.regexp_replace(F.regexp_replace(label, r"([0-9]+)", "00000000$1"), r"0*([0-9]{8})(?![0-9])", "$1")


def manifest(tables: DataFrame) -> DataFrame:
    """(doc_id, label, title, position): the longest title of each label in natural order."""
    best = tables.groupBy("doc_id", "label").agg(F.max_by("title", F.struct(F.length("title").alias("n"), F.col("title").alias("t"))).alias("title"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(natural_key(F.col("label")), "label"))
    return best.withColumn("position", place)


def file_names(tables: DataFrame) -> DataFrame:
    """Adds file_name to (doc_id, label, page_idx): the label, or Table n; a name that is taken gets its page, then a version."""
    base = safe_file_name(F.when(F.col("label") == "", F.concat(F.lit("Table "), F.row_number().over(Window.partitionBy("doc_id", F.col("label") == "").orderBy("page_idx", "table_idx")))).otherwise(F.col("label")), 31)
    rows = tables.withColumn("_base", base)
    nth = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("page_idx", "table_idx"))
    same = F.row_number().over(Window.partitionBy("doc_id", "_base", "page_idx").orderBy("table_idx"))
    rows = rows.withColumn("_n", nth).withColumn("_same", same)
    paged = F.concat(F.col("_base"), F.lit("_p"), F.col("page_idx") + 1)
    return rows.withColumn("file_name", F.when(F.col("_n") == 1, F.col("_base")).when(F.col("_same") == 1, paged).otherwise(F.concat(paged, F.lit("_v"), F.col("_same")))).drop("_base", "_n", "_same")


def column_widths(cells: DataFrame, rows: int = 200) -> DataFrame:
    """(table_id, col_idx, width): longest text of the first rows plus 3, from 10 to 50."""
    return cells.where(F.col("row_idx") < rows).groupBy("table_id", "col_idx").agg(F.least(F.lit(50), F.greatest(F.lit(10), F.max(F.length("text")) + 3)).cast("long").alias("width"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def preview_cards(cells: DataFrame, rows: int = 15) -> DataFrame:
    """(table_id, html): the first rows of each table as an HTML table."""
    shown = cells.where(F.col("row_idx") < rows).withColumn("td", F.concat(F.lit("<td>"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</td>")))
    tables = shown.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx", "td"))).alias("cells"))
    begins = lambda c, k: F.when((k > 0) & (F.get("cells", k - 1)["row_idx"] == c["row_idx"]), c["td"]).otherwise(F.concat(F.when(k > 0, "</tr><tr>").otherwise("<tr>"), c["td"]))
    return tables.select("table_id", F.concat(F.lit("<table>"), F.array_join(F.transform("cells", begins), ""), F.lit("</tr></table>")).alias("html"))


def write_tables(wide: DataFrame, path: str, by: list[str]) -> None:
    """One folder of CSV for each table; Spark's commit protocol makes the write atomic."""
    wide.repartition(*by).sortWithinPartitions(*by, "row_idx").write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
