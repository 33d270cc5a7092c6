"""Relations of tables that are derived from the star schema, as DataFrames; ``SQL`` has the same for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, tasks_of

NAMES = ("Sample", "Qty", "Price (USD)", "Flag", "Code")
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def order_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One table for each order: table_id, row_idx and the line's columns, all or those that are asked for.

    Lines are dealt by order over all tasks: cells are many times as large as lines, and adaptive execution judges by the lines.
    What follows by table_id stays in its task. Lines that agree in the order's columns up to the last one asked for agree in all
    that are asked for, so the columns behind it decide nothing and are neither dealt nor sorted.
    """
    order = _ORDER[: 1 + max(map(_ORDER.index, columns))] if columns else _ORDER
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    rows = spread(lines, "l_orderkey", least=tasks_of(lines))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    return rows.withColumn("row_idx", place).select(F.col("l_orderkey").alias("table_id"), *(columns or order), "row_idx")


def _texts() -> list[Column]:
    part, supp, qty = F.col("l_partkey"), F.col("l_suppkey"), _money("l_quantity")
    dirty = F.when(part % 13 == 0, "").when(part % 13 == 1, "n.d.").when(part % 13 == 2, F.concat(F.lit("<"), qty)).when(part % 13 == 3, F.concat(qty, F.lit(" ± 0.50"))).otherwise(qty)
    code = F.when(supp % 5 == 0, F.concat(F.lit("00"), supp)).when(supp % 5 == 1, F.concat(F.lit("="), supp)).when(supp % 5 == 2, F.concat(F.lit("-"), supp)).otherwise(supp.cast("string"))
    return [F.concat(F.lit("S-"), part), dirty, _money("l_extendedprice"), F.col("l_returnflag"), code]


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_rows(spark, sf_dir, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return rows.select("table_id", "row_idx", F.posexplode(F.array(*_texts())).alias("col_idx", "text"))


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id")).distinct()
    return tables.select("table_id", F.posexplode(F.array(*[F.lit(n) for n in NAMES])).alias("col_idx", "name"))


ROWS_SQL = f"""order_rows AS (
  SELECT *, l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS row_idx FROM lineitem
)"""
CELLS_SQL = (
    ROWS_SQL
    + """, order_cells AS (
  SELECT table_id, row_idx, c.col_idx, CASE c.col_idx
    WHEN 0 THEN 'S-' || l_partkey
    WHEN 1 THEN CASE l_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'n.d.' WHEN 2 THEN '<' || l_quantity::DECIMAL(18,2)::VARCHAR WHEN 3 THEN l_quantity::DECIMAL(18,2)::VARCHAR || ' ± 0.50' ELSE l_quantity::DECIMAL(18,2)::VARCHAR END
    WHEN 2 THEN l_extendedprice::DECIMAL(18,2)::VARCHAR
    WHEN 3 THEN l_returnflag
    ELSE CASE l_suppkey % 5 WHEN 0 THEN '00' || l_suppkey WHEN 1 THEN '=' || l_suppkey WHEN 2 THEN '-' || l_suppkey ELSE l_suppkey::VARCHAR END END AS text
  FROM order_rows CROSS JOIN (VALUES (0), (1), (2), (3), (4)) c(col_idx)
)"""
)
#: The value test as one RE2 expression over x: no lookaround.
DATA_VALUE_SQL = r"""CASE WHEN trim(x) = '' THEN false
  WHEN lower(trim(x)) IN ('-','—','–','n.d.','nd','bdl','b.d.l.','b.d.','n/a','na','n.a.','tr','trace','loq','lod','dl','nil','none','below detection') AND trim(x) NOT IN ('Na','Nd') THEN true
  WHEN regexp_matches(trim(x), '^(?:[A-Z][a-z]?[0-9]*)+$') OR regexp_matches(trim(x), '[/δ‰%]') OR regexp_matches(lower(trim(x)), 'ppm|ppb|wt|sample|spot|no\.|mineral|rock|age|stage|type|depth') THEN false
  WHEN lower(trim(x)) IN ('1σ','2σ','1s','2s','±','1sigma','2sigma','±1σ','±2σ') THEN true
  ELSE regexp_matches(trim(x), '^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$|^[<>≤≥~] *-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$|^-?[0-9]+(\.[0-9]+)? *± *[0-9]+(\.[0-9]+)?$|^-?[0-9]+(\.[0-9]+)? *\([0-9]+\)$')
    OR regexp_matches(lower(trim(x)), '^-?[0-9]+(\.[0-9]+)? *(± *[0-9]+(\.[0-9]+)?)? *(1σ|2σ|1s|2s|1sigma|2sigma)$') END"""


def data_value_sql(column: str) -> str:
    return DATA_VALUE_SQL.replace("(x)", f"({column})").replace("x, '", f"{column}, '")
