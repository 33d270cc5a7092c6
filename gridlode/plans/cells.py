"""Queries on the cells of derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import profile, shape
from .fixtures import CELLS_SQL, ROWS_SQL, data_value_sql, order_cells, order_headers, order_rows, read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("q01_cell_ir", f"WITH {CELLS_SQL} SELECT table_id, row_idx::INT AS row_idx, col_idx, text FROM order_cells")
def q01(spark, d):
    return order_cells(spark, d).select("table_id", "row_idx", "col_idx", "text")


_PROFILE_SQL = f"""WITH {CELLS_SQL}, p AS (
  SELECT table_id, col_idx, count(*)::BIGINT AS n_rows, count(*) FILTER (trim(text) <> '') AS filled,
    count(*) FILTER ({data_value_sql("text")}) AS vals, coalesce(sum(length(trim(text))) FILTER (trim(text) <> ''), 0) AS chars
  FROM order_cells GROUP BY 1, 2)
"""


@query("q02_column_profile", _PROFILE_SQL + "SELECT table_id, col_idx, n_rows, round(vals / greatest(1, filled), 6) AS num_ratio, round((n_rows - filled) / n_rows, 6) AS empty_ratio, round(chars / greatest(1, filled), 6) AS avg_len FROM p")
def q02(spark, d):
    out = profile.column_profile(order_cells(spark, d))
    return out.select("table_id", "col_idx", "n_rows", *[F.round(c, 6).alias(c) for c in ("num_ratio", "empty_ratio", "avg_len")])


@query("q03_fill_and_shape", f"""WITH {CELLS_SQL}, p AS (SELECT table_id, max(row_idx) + 1 AS n_rows, max(col_idx)::BIGINT + 1 AS n_cols, count(*) FILTER (lower(trim(text)) NOT IN ('', 'nan', 'none')) AS n_filled FROM order_cells GROUP BY 1)
SELECT table_id, n_rows, n_cols, n_filled, round(n_filled / (n_rows * n_cols), 6) AS fill_ratio, n_cols > 30 AND n_filled / (n_rows * n_cols) < 0.3 AS fragmented FROM p""")
def q03(spark, d):
    return profile.fill_and_shape(order_cells(spark, d)).withColumn("fill_ratio", F.round("fill_ratio", 6))


@query("q04_pure_data_value", f"WITH {CELLS_SQL} SELECT text, {data_value_sql('text')} AS is_value, count(*) AS n FROM order_cells GROUP BY 1, 2")
def q04(spark, d):
    return order_cells(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", t.is_data_value(F.col("text")).alias("is_value"), "n")


_TYPES_SQL = r"""CASE WHEN trim(text) = '' THEN 'empty'
  WHEN regexp_matches(trim(replace(text, ',', '')), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$')
   AND NOT regexp_matches(trim(replace(text, ',', '')), '^[+-]?0[0-9]+$')
   AND NOT (regexp_matches(trim(replace(text, ',', '')), '^[+-]?[0-9]+$') AND length(ltrim(trim(replace(text, ',', '')), '+-')) > 15)
  THEN CASE WHEN contains(lower(text), 'e') OR contains(text, '.') THEN 'float' ELSE 'int' END ELSE 'text' END"""


@query("q05_type_inference", f"""WITH {CELLS_SQL}, k AS (SELECT table_id, row_idx, col_idx, text, {_TYPES_SQL} AS kind FROM order_cells),
s AS (SELECT table_id, col_idx, count(*) FILTER (kind IN ('int', 'float') AND lower(trim(text)) NOT IN ('', 'nan', 'none')) AS numbers, count(*) FILTER (lower(trim(text)) NOT IN ('', 'nan', 'none')) AS filled FROM k GROUP BY 1, 2)
SELECT kind, col_idx, numbers > 0 AND numbers * 2 >= filled AND kind IN ('int', 'float') AS typed, count(*) AS n,
  round(coalesce(sum(CASE WHEN kind IN ('int', 'float') THEN replace(text, ',', '')::DOUBLE END), 0), 2) AS total
FROM k JOIN s USING (table_id, col_idx) GROUP BY 1, 2, 3""")
def q05(spark, d):
    typed = profile.infer_types(order_cells(spark, d))
    return typed.groupBy("kind", "col_idx", "typed").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("num"), F.lit(0.0)), 2).alias("total"))


@query("q06_formula_escape", f"WITH {CELLS_SQL}, k AS (SELECT text, {_TYPES_SQL} AS kind FROM order_cells) SELECT CASE WHEN regexp_matches(text, '^[=+@-]') AND kind NOT IN ('int', 'float') THEN '''' || text ELSE text END AS safe, CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END AS quoted, count(*) AS n FROM k GROUP BY 1, 2")
def q06(spark, d):
    return order_cells(spark, d).groupBy(t.escape_formula(F.col("text")).alias("safe"), t.escape_formula(F.col("text"), False).alias("quoted")).agg(F.count(F.lit(1)).alias("n"))


@query("q07_merge_key", """SELECT c_custkey, c_custkey::VARCHAR AS k_int, c_custkey::VARCHAR AS k_float, '0' || c_custkey AS k_code,
  CASE WHEN c_acctbal = 0 THEN '0' ELSE regexp_replace(regexp_replace(c_acctbal::DECIMAL(18,2)::VARCHAR, '0+$', ''), '\\.$', '') END AS k_bal, lower(c_name) AS k_name FROM customer""".replace("\\\\", "\\"))
def q07(spark, d):
    key = F.col("c_custkey").cast("string")
    return read(spark, d, "customer").select(
        "c_custkey", t.merge_key(F.concat(F.lit(" "), key)).alias("k_int"), t.merge_key(F.concat(key, F.lit(".00"))).alias("k_float"), t.merge_key(F.concat(F.lit("+0"), key)).alias("k_code"),
        t.merge_key(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("k_bal"), t.merge_key(F.upper("c_name")).alias("k_name"),
    )


@query("q08_label_format", """WITH r AS (SELECT o_orderkey % 97 AS n FROM orders)
SELECT CASE n % 4 WHEN 0 THEN 'TABLE ' || n || '. Orders' WHEN 1 THEN 'Tab. ' || n WHEN 2 THEN '表 ' || n || '.1' ELSE 'Supplementary  Table S' || n || ': more' END AS raw,
  CASE n % 4 WHEN 0 THEN 'Table ' || n WHEN 1 THEN 'Table ' || n WHEN 2 THEN '表' || n || '.1' ELSE 'Supplementary Table S' || n END AS label, n % 4 = 3 AS supplementary, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def q08(spark, d):
    rows = read(spark, d, "orders")
    n = F.col("o_orderkey") % 97
    raw = F.when(n % 4 == 0, F.concat(F.lit("TABLE "), n, F.lit(". Orders"))).when(n % 4 == 1, F.concat(F.lit("Tab. "), n)).when(n % 4 == 2, F.concat(F.lit("表 "), n, F.lit(".1"))).otherwise(F.concat(F.lit("Supplementary  Table S"), n, F.lit(": more")))
    return rows.select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", t.canonical_label(F.col("raw")).alias("label"), t.is_supplementary(F.col("raw")).alias("supplementary"), "n")


@query("q09_unique_columns", f"""WITH {ROWS_SQL}, h AS (SELECT table_id, row_idx AS col_idx, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag || l_linestatus END AS name FROM order_rows),
n AS (SELECT table_id, col_idx, CASE WHEN trim(name) = '' THEN 'Col_' || (col_idx + 1) ELSE trim(name) END AS name FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY col_idx) AS k FROM n)
SELECT table_id, col_idx::INT AS col_idx, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS name FROM r""")
def q09(spark, d):
    rows = order_rows(spark, d)
    heads = rows.select("table_id", F.col("row_idx").alias("col_idx"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("name"))
    return shape.unique_names(heads)


@query("q12_numeric_tokens", r"""WITH n AS (SELECT source, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS tok FROM documents)
SELECT source, tok::DOUBLE AS value, count(*) AS n FROM n GROUP BY 1, 2""")
def q12(spark, d):
    toks = read(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("tok"))
    return toks.groupBy("source", F.col("tok").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("q80_all_numeric_tokens")
def q80(spark, d):
    """Every numeric token by its canonical value, with signs, commas, exponents and ranges; q12 counts bare runs of digits as doubles."""
    toks = read(spark, d, "documents").select("source", F.explode(t.numeric_tokens(F.col("text"))).alias("value"))
    return toks.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))


_SQUEEZED = "table_id, row_idx, col_idx, CASE WHEN col_idx = 1 AND table_id % 3 = 0 THEN qty || ' ' || price WHEN col_idx = 1 THEN qty WHEN col_idx = 2 THEN price ELSE 'S' || l_partkey END AS text"
_SQUEEZED_CTE = f"""{ROWS_SQL}, base AS (SELECT table_id, row_idx, l_partkey, l_quantity::DECIMAL(18,2)::VARCHAR AS qty, l_extendedprice::DECIMAL(18,2)::VARCHAR AS price FROM order_rows),
cells AS (SELECT {_SQUEEZED} FROM base CROSS JOIN (VALUES (0), (1), (2)) c(col_idx)),
toks AS (SELECT *, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS t FROM cells WHERE lower(trim(text)) NOT IN ('', 'nan', 'none')),
ks AS (SELECT table_id, col_idx, row_idx, CASE WHEN len(t) >= 2 AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^[<>]?[-+]?[0-9]+(\\.[0-9]+)?([%‰]|×10[-+]?[0-9]+)?$'))) = 0 THEN len(t) END AS k FROM toks),
byk AS (SELECT table_id, col_idx, k, count(*) AS n, min(row_idx) AS first_row FROM ks GROUP BY 1, 2, 3),
best AS (SELECT table_id, col_idx, sum(n) AS filled, max(CASE WHEN k IS NOT NULL THEN n END) AS modal_n, arg_max(k, struct_pack(a := CASE WHEN k IS NULL THEN -1 ELSE n END, b := -first_row)) AS mk FROM byk GROUP BY 1, 2),
sq AS (SELECT table_id, col_idx, coalesce(mk, 1)::BIGINT AS modal_tokens, coalesce(filled >= 4 AND modal_n >= 3 AND modal_n * 2 >= filled, false) AS squeezed FROM best)"""


def _squeezed_cells(spark, d):
    rows = order_rows(spark, d)
    qty, price = (F.col(c).cast("decimal(18,2)").cast("string") for c in ("l_quantity", "l_extendedprice"))
    both = F.when(F.col("table_id") % 3 == 0, F.concat_ws(" ", qty, price)).otherwise(qty)
    return rows.select("table_id", "row_idx", F.posexplode(F.array(F.concat(F.lit("S"), F.col("l_partkey")), both, price)).alias("col_idx", "text"))


@query("q20_squeezed_columns", f"WITH {_SQUEEZED_CTE} SELECT * FROM sq")
def q20(spark, d):
    return profile.squeezed_columns(_squeezed_cells(spark, d))


@query("q21_expand_squeezed", f"""WITH {_SQUEEZED_CTE}, k AS (SELECT table_id, col_idx, CASE WHEN squeezed THEN modal_tokens ELSE 1 END AS k FROM sq),
placed AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY table_id ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM k),
wide AS (SELECT c.*, p.k, p.first, list_filter(string_split_regex(trim(c.text), '\\s+'), lambda x: x <> '') AS t FROM cells c JOIN placed p USING (table_id, col_idx)),
split AS (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM wide)
SELECT table_id, row_idx::INT AS row_idx, (first + i)::INT AS col_idx, CASE WHEN k = 1 THEN text WHEN i < k - 1 THEN coalesce(t[i + 1], '') ELSE coalesce(array_to_string(t[k:], ' '), '') END AS text FROM split""")
def q21(spark, d):
    return shape.expand_squeezed(_squeezed_cells(spark, d))


@query("q22_multiline_rows", f"""WITH {ROWS_SQL}, cells AS (SELECT table_id, row_idx, c.col_idx, CASE c.col_idx WHEN 0 THEN l_returnflag WHEN 1 THEN CASE WHEN l_partkey % 4 = 0 THEN 'a' || l_partkey || chr(10) || 'b' || l_suppkey WHEN l_partkey % 4 = 1 THEN 'x' || chr(10) || 'y' || chr(10) || l_linenumber ELSE 'one' END
  ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'u' || chr(10) || ' v ' ELSE l_linestatus END END AS text FROM order_rows CROSS JOIN (VALUES (0), (1), (2)) c(col_idx)),
l AS (SELECT *, string_split(text, chr(10)) AS lines FROM cells), h AS (SELECT table_id, row_idx, max(len(lines)) AS h FROM l GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM h),
x AS (SELECT l.*, p.first, unnest(generate_series(0, p.h - 1)) AS i FROM l JOIN p USING (table_id, row_idx))
SELECT table_id, (first + i)::BIGINT AS row_idx, col_idx, trim(CASE WHEN len(lines) = 1 THEN lines[1] ELSE coalesce(lines[i + 1], '') END) AS text FROM x""")
def q22(spark, d):
    rows = order_rows(spark, d)
    nl, part = F.lit("\n"), F.col("l_partkey")
    one = F.when(part % 4 == 0, F.concat(F.lit("a"), part, nl, F.lit("b"), F.col("l_suppkey"))).when(part % 4 == 1, F.concat(F.lit("x\ny\n"), F.col("l_linenumber"))).otherwise("one")
    two = F.when(F.col("l_suppkey") % 3 == 0, F.lit("u\n v ")).otherwise(F.col("l_linestatus"))
    return shape.expand_multiline(rows.select("table_id", "row_idx", F.posexplode(F.array("l_returnflag", one, two)).alias("col_idx", "text")))


@query("q23_section_fill", f"""WITH {ROWS_SQL}, r AS (SELECT table_id, row_idx, CASE WHEN l_partkey % 3 = 0 THEN 'Group ' || l_returnflag WHEN l_partkey % 3 = 1 THEN 'sampled' ELSE 'row' END AS head, (CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 2 = 0 THEN 0 ELSE 1 END) AS others FROM order_rows),
s AS (SELECT *, regexp_matches(lower(head), '^(sample|group|zone|unit|phase|formation|member|type|deposit)') AND others <= 2 * 0.3 AS is_section FROM r)
SELECT table_id, row_idx::INT AS row_idx, is_section, last_value(CASE WHEN is_section THEN head END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_idx) AS category FROM s""")
def q23(spark, d):
    rows, part = order_rows(spark, d), F.col("l_partkey")
    head = F.when(part % 3 == 0, F.concat(F.lit("Group "), F.col("l_returnflag"))).when(part % 3 == 1, "sampled").otherwise("row")
    value = F.when((part % 3 == 0) & (F.col("l_suppkey") % 2 == 0), "").otherwise("7")
    return shape.section_categories(rows.select("table_id", "row_idx", F.posexplode(F.array(head, value, F.lit(""))).alias("col_idx", "text")))


@query("q24_header_flatten", """WITH p AS (SELECT p_partkey AS table_id, p_brand, p_type FROM part),
h AS (SELECT table_id, unnest([struct_pack(col_idx := 0, name := 'Id'), struct_pack(col_idx := 1, name := p_brand || ' > Qty'), struct_pack(col_idx := 2, name := p_brand || ' > Price'),
  struct_pack(col_idx := 3, name := CASE WHEN table_id % 2 = 0 THEN 'Total wt' ELSE 'Total > Share' END), struct_pack(col_idx := 4, name := 'Total')]) AS c FROM p)
SELECT table_id, c.col_idx AS col_idx, c.name AS name FROM h""")
def q24(spark, d):
    parts = read(spark, d, "part").withColumnRenamed("p_partkey", "table_id")
    top = F.array(F.lit("Id"), F.col("p_brand"), F.lit(""), F.lit("Total"), F.lit("nan"))
    low = F.array(F.lit("ID"), F.lit("Qty"), F.lit("Price"), F.when(F.col("table_id") % 2 == 0, "Total wt").otherwise("Share"), F.lit(""))
    levels = parts.select("table_id", F.explode(F.array(F.struct(F.lit(0).alias("level"), top.alias("v")), F.struct(F.lit(1).alias("level"), low.alias("v")))).alias("s"))
    # an empty text below another goes on with the text on its left
    return shape.flatten_headers(levels.select("table_id", "s.level", F.posexplode("s.v").alias("col_idx", "text")))


@query("q25_header_promote", f"""WITH {CELLS_SQL}, w AS (SELECT table_id, CASE WHEN table_id % 3 = 0 THEN row_idx + 1 ELSE row_idx END AS row_idx, col_idx, text FROM order_cells
  UNION ALL SELECT DISTINCT table_id, 0, c.col_idx, CASE c.col_idx WHEN 0 THEN 'Sample' WHEN 1 THEN 'Qty' WHEN 2 THEN '2020' WHEN 3 THEN 'Flag' ELSE 'Code' END FROM order_cells CROSS JOIN (VALUES (0), (1), (2), (3), (4)) c(col_idx) WHERE table_id % 3 = 0),
n AS (SELECT *, trim(text) AS s, regexp_matches(replace(trim(text), ',', ''), '^([<>≤≥] *)?[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') OR regexp_matches(lower(trim(text)), '^(n\\.? *d\\.?|b\\.?d\\.?l\\.?|n/?a|none|[-–—]+)$') AS num, regexp_matches(trim(text), '^(18[0-9]{{2}}|19[0-9]{{2}}|20[0-9]{{2}}|2100)$') AS yr FROM w),
c AS (SELECT table_id, col_idx, max(s) FILTER (row_idx = 0) AS head, bool_or(num) FILTER (row_idx = 0) AS hn, bool_or(yr) FILTER (row_idx = 0) AS hy, max(row_idx) AS last, count(*) FILTER (row_idx > 0 AND s <> '') AS n, count(*) FILTER (row_idx > 0 AND s <> '' AND num) AS nums, count(*) FILTER (row_idx > 0 AND s <> '' AND yr) AS yrs FROM n GROUP BY 1, 2),
t AS (SELECT table_id, max(last) AS last, bool_or(hn AND NOT hy AND n > 0 AND nums * 2 >= n) AS blocked, bool_or(hy AND n > 0 AND nums * 2 >= n AND NOT yrs * 2 >= n) AS y, bool_and(hy AND n > 0 AND NOT yrs * 2 >= n) AS ally, bool_or(NOT hn AND head <> '' AND n > 0 AND nums * 2 >= n) AS tx, bool_or(lower(head) IN ('sample', 'code')) AS kw FROM c GROUP BY 1)
SELECT table_id, last >= 1 AND NOT blocked AND (y OR ally OR tx OR kw) AS promote FROM t""")
def q25(spark, d):
    cells = order_cells(spark, d)
    moved = cells.select("table_id", F.when(F.col("table_id") % 3 == 0, F.col("row_idx") + 1).otherwise(F.col("row_idx")).alias("row_idx"), "col_idx", "text")
    heads = order_headers(spark, d).where("table_id % 3 = 0").select("table_id", F.lit(0).alias("row_idx"), "col_idx", F.when(F.col("col_idx") == 2, "2020").otherwise(F.col("name")).alias("text"))
    return profile.promotable_first_rows(moved.unionByName(heads))


_NOTED = """, noted AS (SELECT table_id, row_idx, col_idx, text FROM order_cells
  UNION ALL SELECT table_id, last + k.k, c.col_idx, CASE WHEN c.col_idx > 0 THEN '' WHEN k.k = 1 THEN 'Note: values of order ' || table_id ELSE '* p < 0.05 compared with the others' END
  FROM (SELECT table_id, max(row_idx) AS last FROM order_cells GROUP BY 1) CROSS JOIN (VALUES (1), (2)) k(k) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) c(col_idx) WHERE table_id % 2 = 0)"""


@query("q26_footnote_split", f"""WITH {CELLS_SQL}{_NOTED}, r AS (SELECT table_id, row_idx, max(CASE WHEN col_idx = 0 AND regexp_matches(text, '^(Note:|\\*)') THEN text END) AS note FROM noted GROUP BY 1, 2),
f AS (SELECT *, bool_and(note IS NOT NULL) OVER (PARTITION BY table_id ORDER BY row_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AND row_idx > 0 AS in_footer FROM r) SELECT table_id, row_idx::INT AS row_idx, in_footer, note FROM f""")
def q26(spark, d):
    cells = order_cells(spark, d).select("table_id", "row_idx", "col_idx", "text")
    last = cells.groupBy("table_id").agg(F.max("row_idx").alias("last")).where("table_id % 2 = 0")
    texts = F.array(F.concat(F.lit("Note: values of order "), F.col("table_id")), F.lit("* p < 0.05 compared with the others"))
    notes = last.select("table_id", "last", F.posexplode(texts).alias("k", "t")).select("table_id", (F.col("last") + F.col("k") + 1).alias("row_idx"), F.posexplode(F.array("t", *[F.lit("")] * 4)).alias("col_idx", "text"))
    return shape.split_footnotes(cells.unionByName(notes)).withColumn("row_idx", F.col("row_idx").cast("int"))


@query("q27_noise_rows", f"""WITH {CELLS_SQL}, c AS (SELECT table_id, row_idx, col_idx, CASE WHEN row_idx > 0 AND row_idx % 5 = 4 THEN CASE col_idx WHEN 0 THEN 'Sample' WHEN 1 THEN 'qty' WHEN 2 THEN 'Price' WHEN 3 THEN 'Flag' ELSE 'Code' END
   WHEN row_idx % 5 = 3 THEN CASE WHEN col_idx = 0 THEN '(continued)' ELSE '' END WHEN row_idx % 7 = 6 THEN '' ELSE text END AS text FROM order_cells),
r AS (SELECT table_id, row_idx, count(*) FILTER (lower(trim(text)) NOT IN ('', 'nan')) AS n, count(*) FILTER ({data_value_sql("text")}) AS vals, count(*) FILTER (lower(trim(text)) IN ('sample', 'qty', 'price (usd)', 'price', '(usd)', 'flag', 'code')) AS hits, bool_or(regexp_matches(lower(trim(text)), '^(续表|接上表|\\(contd|\\(continued|continued table)')) AS cont FROM c GROUP BY 1, 2)
SELECT CASE WHEN n = 0 THEN 'empty' WHEN row_idx > 0 AND n <= 2 AND cont THEN 'continued' WHEN row_idx > 0 AND vals = 0 AND hits >= 2 AND hits * 4 >= n * 3 THEN 'repeated_header' END AS noise, count(*) AS n, sum(table_id)::BIGINT AS ids FROM r GROUP BY 1""")
def q27(spark, d):
    i, c = F.col("row_idx"), F.col("col_idx")
    header = F.get(F.array(*[F.lit(x) for x in ("Sample", "qty", "Price", "Flag", "Code")]), c)
    text = F.when((i > 0) & (i % 5 == 4), header).when(i % 5 == 3, F.when(c == 0, "(continued)").otherwise("")).when(i % 7 == 6, "").otherwise(F.col("text"))
    noise = shape.noise_rows(order_cells(spark, d).withColumn("text", text), order_headers(spark, d))
    return noise.groupBy("noise").agg(F.count(F.lit(1)).alias("n"), F.sum("table_id").alias("ids"))


@query("q28_span_expand", f"""WITH {ROWS_SQL}, c AS (SELECT table_id, row_idx * 3 AS row_idx, 1 + l_partkey % 3 AS rs, 1 + l_suppkey % 2 AS cs, 'P' || l_partkey AS text FROM order_rows),
r AS (SELECT *, unnest(generate_series(0, rs - 1)) AS dr FROM c), x AS (SELECT *, unnest(generate_series(0, cs - 1)) AS dc FROM r) SELECT table_id, (row_idx + dr)::INT AS row_idx, dc::INT AS col_idx, text FROM x""")
def q28(spark, d):
    rows = order_rows(spark, d)
    cells = rows.select("table_id", (F.col("row_idx") * 3).alias("row_idx"), F.lit(0).alias("col_idx"), F.concat(F.lit("P"), F.col("l_partkey")).alias("text"), (1 + F.col("l_partkey") % 3).cast("int").alias("row_span"), (1 + F.col("l_suppkey") % 2).cast("int").alias("col_span"))
    return shape.spread_spans(cells)


@query("q53_market_segments", _PROFILE_SQL.replace("p AS (", "seg AS (SELECT o_orderkey AS table_id, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey), p AS (") + """SELECT c_mktsegment, count(DISTINCT table_id)::BIGINT AS n_tables, count(*)::BIGINT AS n_columns, sum(n_rows)::BIGINT AS n_cells, round(sum(filled) / sum(n_rows), 6) AS fill_ratio, round(sum(vals) / sum(filled), 6) AS value_ratio
FROM p JOIN seg USING (table_id) GROUP BY ROLLUP (c_mktsegment)""")
def q53(spark, d):
    """Flagship: derived tables, fill and share of values for each market segment and in all."""
    segment = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("table_id"), "c_mktsegment")
    text = F.col("text")
    by_table = order_cells(spark, d).groupBy("table_id").agg(F.countDistinct("col_idx").alias("cols"), F.count(F.lit(1)).alias("cells"), F.count_if(F.trim(text) != "").alias("filled"), F.count_if(t.is_data_value(text)).alias("vals"))
    out = by_table.join(segment, "table_id").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("cols").alias("n_columns"), F.sum("cells").alias("n_cells"), F.sum("filled").alias("f"), F.sum("vals").alias("v"))
    return out.select("c_mktsegment", "n_tables", "n_columns", "n_cells", F.round(F.col("f") / F.col("n_cells"), 6).alias("fill_ratio"), F.round(F.col("v") / F.col("f"), 6).alias("value_ratio"))
