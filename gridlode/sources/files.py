"""Plain sources: CSV tables as text, lists of inputs, caption manifests, structured archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nothing inferred, empty cells as empty strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


def read_input_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) for each line that is neither empty nor a comment."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).where("path <> '' and not path like '#%'")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(label, title) of lines ``label<TAB>title``."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.trim(F.get(parts, 0)).alias("label"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("title")).where("label <> ''")


def archive_tables(docs: DataFrame, column: str = "json") -> DataFrame:
    """(doc_id, item_no, page_idx, caption, footnotes, html, bbox) of structured content lists: the items that are tables."""
    item = "array<struct<type:string,page_idx:int,table_body:string,table_caption:array<string>,table_footnote:array<string>,bbox:array<double>>>"
    rows = docs.select("doc_id", F.posexplode(F.from_json(column, item)).alias("item_no", "i")).where("i.type = 'table' and i.table_body is not null")
    return rows.select("doc_id", "item_no", F.coalesce("i.page_idx", F.lit(0)).alias("page_idx"), F.array_join("i.table_caption", " ").alias("caption"), F.col("i.table_footnote").alias("footnotes"), F.col("i.table_body").alias("html"), F.col("i.bbox").alias("bbox"))
