"""Relational form of tables that are found in documents: one row a table, one row a cell."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

CELLS = T.StructType([
    T.StructField("table_id", T.StringType()), T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("row_span", T.IntegerType()), T.StructField("col_span", T.IntegerType()), T.StructField("is_header", T.BooleanType()),
])

TABLES = T.StructType([
    T.StructField("table_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("page_idx", T.IntegerType()), T.StructField("table_idx", T.IntegerType()),
    T.StructField("label", T.StringType()), T.StructField("title", T.StringType()), T.StructField("bbox", BOX), T.StructField("bbox_format", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("extractor", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("n_rows", T.IntegerType()), T.StructField("n_cols", T.IntegerType()), T.StructField("header_source", T.StringType()), T.StructField("is_continuation", T.BooleanType()),
    T.StructField("covered_pages", T.ArrayType(T.IntegerType())), T.StructField("footnotes", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

WORDS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("page_idx", T.IntegerType()), T.StructField("word_no", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")], T.StructField("text", T.StringType()), T.StructField("font_size", T.DoubleType()), T.StructField("is_bold", T.BooleanType()),
])
