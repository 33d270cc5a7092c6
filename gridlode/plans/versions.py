"""Queries on versions of tables, audits and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.matching import scored_pairs
from ..operators import arbitrate, audit, catalog, profile, similarity
from .cells import _SQUEEZED_CTE, _squeezed_cells
from .fixtures import CELLS_SQL, NAMES, ROWS_SQL, order_cells, order_headers, order_rows, read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("q18_title_similarity", r"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark), e AS (SELECT item_id, unnest(w) AS x, len(w) AS n FROM w),
p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, count(*) AS i, max(a.n) AS na, max(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.item_id < b.item_id GROUP BY 1, 2) SELECT a_id, b_id, round(i / (na + nb - i), 6) AS similarity FROM p WHERE i / (na + nb - i) >= 0.1""")
def q18(spark, d):
    items = read(spark, d, "benchmark").select("item_id", t.word_set(F.col("text")).alias("w"))
    words = items.select("item_id", F.explode("w").alias("x"), F.size("w").alias("n"))
    a, b = (words.select(F.col("item_id").alias(f"{s}_id"), "x", F.col("n").alias(f"n{s}")) for s in "ab")
    shared = a.join(b, "x").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("i"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    s = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    return shared.where(s >= 0.1).select("a_id", "b_id", F.round(s, 6).alias("similarity"))


@query("q19_levenshtein_ratio", """WITH p AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT a_id, b_id, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS ratio FROM p""")
def q19(spark, d):
    p = read(spark, d, "part")
    return scored_pairs(p, "p_partkey", "p_name", ["p_brand", "p_type", "p_size"], t.levenshtein_ratio)


def _versions(spark, d):
    """Extractor A has all rows, B drops every fifth and shifts quantities."""
    a = order_cells(spark, d).select(F.col("table_id").alias("id"), "row_idx", "col_idx", "text")
    b = a.where("row_idx % 5 <> 4").select("id", F.expr("row_idx - row_idx div 5").alias("row_idx"), "col_idx", F.when((F.col("col_idx") == 1) & (F.col("row_idx") % 3 == 1), F.concat(F.lit("1"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return a.select("id").distinct().select(F.col("id").alias("pair_id"), F.col("id").alias("a_id"), F.col("id").alias("b_id")), a, b


_VERSION_SQL = f"""{CELLS_SQL}, a AS (SELECT table_id AS id, row_idx, col_idx, lower(trim(text)) AS v FROM order_cells),
b AS (SELECT table_id AS id, row_idx - row_idx // 5 AS row_idx, col_idx, lower(trim(CASE WHEN col_idx = 1 AND row_idx % 3 = 1 THEN '1' || text ELSE text END)) AS v FROM order_cells WHERE row_idx % 5 <> 4),
k AS (SELECT id, ra, rb, least(ra, rb) AS r FROM (SELECT id, max(row_idx) + 1 AS ra FROM a GROUP BY 1) JOIN (SELECT id, max(row_idx) + 1 AS rb FROM b GROUP BY 1) USING (id)),
m AS (SELECT a.id, o.turn, CASE WHEN a.v = '' AND b.v = '' THEN 0.0 WHEN a.v = b.v THEN 1.0 WHEN a.v <> '' AND b.v <> '' AND (contains(a.v, b.v) OR contains(b.v, a.v)) THEN 0.5 ELSE 0.0 END AS s
  FROM a JOIN k ON a.id = k.id AND a.row_idx < k.r CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) o(turn, off) JOIN b ON b.id = a.id AND b.row_idx = a.row_idx + o.off AND b.col_idx = a.col_idx),
tt AS (SELECT id, turn, avg(s::DOUBLE) AS s FROM m GROUP BY 1, 2), best AS (SELECT id, coalesce(arg_min(s, turn) FILTER (s >= 0.8), max(s)) AS content FROM tt GROUP BY 1),
st AS (SELECT id, v, max(x) AS x, max(y) AS y FROM (SELECT id, v, 1 AS x, 0 AS y FROM a WHERE v <> '' UNION ALL SELECT id, v, 0, 1 FROM b WHERE v <> '') GROUP BY 1, 2), j AS (SELECT id, sum(x * y) / count(*) AS jac FROM st GROUP BY 1),
f AS (SELECT k.id, ra / greatest(ra, rb) * rb / greatest(ra, rb) AS shape, coalesce(content, 0) AS content, coalesce(jac, 0) AS jac FROM k LEFT JOIN best USING (id) LEFT JOIN j USING (id)),
z AS (SELECT id, content, jac, least(ra, rb) / greatest(ra, rb) AS shape FROM f JOIN k USING (id))"""


@query("q46_content_similarity", f"WITH {_VERSION_SQL} SELECT id AS pair_id, round(content, 6) AS content, round(jac, 6) AS value_jaccard, round(shape, 6) AS shape, round(CASE WHEN content < 0.1 AND jac < 0.1 THEN 0 ELSE 0.2 * shape + 0.55 * content + 0.25 * jac END, 6) AS similarity FROM z")
def q46(spark, d):
    pairs, a, b = _versions(spark, d)
    s = similarity.combined(similarity.content_similarity(pairs, a, b))
    return s.select("pair_id", *[F.round(c, 6).alias(c) for c in ("content", "value_jaccard", "shape", "similarity")])


@query("q47_teds")
def q47(spark, d):
    pairs, a, b = _versions(spark, d)
    rows = lambda df: df.groupBy("id", "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"]).alias("r")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "r"))), lambda x: x["r"]).alias("rows")).withColumn("header", F.array(*[F.lit(n) for n in NAMES]))
    return similarity.tree_scores(pairs, rows(a), rows(b)).select("pair_id", F.round("tree", 6).alias("tree"))


@query("q48_vote", f"""WITH {_VERSION_SQL}, s AS (SELECT id, CASE WHEN content < 0.1 AND jac < 0.1 THEN 0 ELSE 0.2 * shape + 0.55 * content + 0.25 * jac END AS sim FROM z), n AS (SELECT id, ra, rb FROM k)
SELECT id AS doc_id, id * 2 AS winner, sim < 0.9 AND sim < 0.75 AS low_confidence, ra - rb >= 2 AS n_rows_differ FROM s JOIN n USING (id)""")
def q48(spark, d):
    pairs, a, b = _versions(spark, d)
    size = lambda df, p: df.groupBy("id").agg((F.max("row_idx") + 1).alias("n_rows")).select(F.col("id").alias("doc_id"), (F.col("id") * 2 + p).alias("id"), F.lit(p).alias("priority"), "n_rows")
    s = similarity.combined(similarity.content_similarity(pairs, a, b)).select(F.col("pair_id").alias("doc_id"), (F.col("pair_id") * 2).alias("a_id"), (F.col("pair_id") * 2 + 1).alias("b_id"), F.lit(0).alias("a_priority"), F.lit(1).alias("b_priority"), "similarity")
    return arbitrate.vote(size(a, 0).unionByName(size(b, 1)), s, ["doc_id"])


@query("q49_dedup")
def q49(spark, d):
    li = read(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") % 5000).alias("page"), F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("value"))
    return arbitrate.drop_sharing(rows, ["page"])


@query("q49b_cluster_versions")
def q49b(spark, d):
    pairs, a, b = _versions(spark, d)
    doc, page = (F.expr("id div 3").alias("doc_id"), F.lit(0).alias("page_idx"))
    cand = pairs.select(F.col("pair_id").alias("id")).select(doc, page, F.explode(F.array(F.struct((F.col("id") * 2).alias("id"), F.lit(0).alias("priority")), F.struct((F.col("id") * 2 + 1).alias("id"), F.lit(1).alias("priority")))).alias("c")).select("doc_id", "page_idx", "c.id", "c.priority", F.lit("").alias("label"), F.lit(False).alias("boxed"))
    s = similarity.combined(similarity.content_similarity(pairs, a, b)).withColumnRenamed("pair_id", "id").select(doc, page, (F.col("id") * 2).alias("a_id"), (F.col("id") * 2 + 1).alias("b_id"), "similarity", F.lit(0.0).alias("iou"), F.lit(0.0).alias("iom"))
    return arbitrate.cluster_versions(cand, s)


_GATE = f"""{ROWS_SQL}, n AS (SELECT table_id, count(*) AS n_rows, 5 AS n_cols, count(*) * 5 AS n_filled, list_distinct(list(l_partkey)) AS samples, table_id % 7 = 0 AS low FROM order_rows GROUP BY 1),
o AS (SELECT table_id, count(*) AS n_rows, 5 AS n_cols, count(*) * CASE WHEN table_id % 4 = 0 THEN 4 ELSE 5 END AS n_filled, list_distinct(list(l_partkey)) AS samples, table_id % 11 = 0 AS low FROM order_rows WHERE NOT (table_id % 3 = 0 AND row_idx = 2) GROUP BY 1)"""


@query("q50_replace_gate", f"""WITH {_GATE}, x AS (SELECT n.table_id, n.n_filled AS nf, o.n_filled AS f, n.n_rows AS nr, o.n_rows AS r, n.low AS nl, o.low AS ol, len(list_filter(n.samples, lambda s: NOT list_contains(o.samples, s))) AS lost FROM n JOIN o USING (table_id)),
y AS (SELECT table_id, CASE WHEN ol AND NOT nl THEN 'other_bad' WHEN lost > 0 THEN 'sample_lost' WHEN nl THEN CASE WHEN f >= 0.75 * nf THEN 'repaired' ELSE 'not_enough' END WHEN r >= nr AND f >= 0.95 * nf THEN 'no_less' ELSE 'truncated' END AS reason FROM x)
SELECT table_id, reason IN ('repaired', 'no_less') AS replace, reason FROM y""")
def q50(spark, d):
    rows = order_rows(spark, d)
    side = lambda df, cells, low: df.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set("l_partkey").alias("samples")).select("table_id", "n_rows", F.lit(5).alias("n_cols"), (F.col("n_rows") * cells).alias("n_filled"), (F.col("table_id") % low == 0).alias("low_quality"), "samples")
    other = side(rows.where("not (table_id % 3 = 0 and row_idx = 2)"), F.when(F.col("table_id") % 4 == 0, 4).otherwise(5), 11)
    return arbitrate.replacement_gate(side(rows, F.lit(5), 7), other)


@query("q51_semantic_equiv", f"""WITH {ROWS_SQL}, a AS (SELECT table_id, list_distinct(list(l_partkey::VARCHAR)) AS v FROM order_rows GROUP BY 1), b AS (SELECT table_id, list_distinct(list(CASE WHEN l_partkey % 9 = 0 THEN 'x' ELSE l_partkey::VARCHAR END)) AS v FROM order_rows GROUP BY 1),
j AS (SELECT table_id AS pair_id, CASE WHEN table_id % 3 = 0 THEN 1 / 2 ELSE 1.0 END AS cj, len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) AS vj FROM a JOIN b USING (table_id)) SELECT pair_id, round(cj, 6)::DOUBLE AS column_jaccard, round(vj, 6) AS value_jaccard, 0.4 * cj + 0.6 * vj >= 0.85 AS equivalent FROM j""")
def q51(spark, d):
    rows = order_rows(spark, d)
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("sample"))).otherwise(F.array(F.lit("sample"), F.lit("qty")))
    part = F.col("l_partkey").cast("string")
    left = rows.groupBy(F.col("table_id").alias("id")).agg(F.collect_set(part).alias("values")).withColumn("columns", F.array(F.lit("sample"), F.lit("qty")))
    right = rows.groupBy(F.col("table_id").alias("id")).agg(F.collect_set(F.when(F.col("l_partkey") % 9 == 0, "x").otherwise(part)).alias("values")).withColumn("columns", names)
    pairs = left.select(F.col("id").alias("pair_id"), F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    out = similarity.semantic_equivalence(pairs, left, right)
    return out.select("pair_id", F.round("column_jaccard", 6).alias("column_jaccard"), F.round("value_jaccard", 6).alias("value_jaccard"), "equivalent")


@query("q52_ground_truth_eval", f"""WITH {ROWS_SQL}, w AS (SELECT table_id AS doc_id, row_idx, l_quantity AS want, CASE WHEN row_idx % 5 = 4 THEN NULL WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity * 1.001 END AS got FROM order_rows),
r AS (SELECT doc_id, row_idx, count(*) AS n, count(*) FILTER (NOT coalesce(abs(got - want) <= greatest(1e-3, 0.01 * abs(want)), false)) AS wrong, bool_or(got IS NOT NULL) AS seen FROM w GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS n_cells, sum(wrong)::BIGINT AS n_wrong, count(*) FILTER (NOT seen) AS n_missing_rows, round(sum(wrong) / sum(n), 6) AS error_rate FROM r GROUP BY 1""")
def q52(spark, d):
    rows = order_rows(spark, d, "l_partkey", "l_quantity").select(F.col("table_id").alias("doc_id"), "row_idx", F.lit(1).alias("col_idx"), "l_partkey", F.col("l_quantity").alias("num"))
    got = rows.where("row_idx % 5 <> 4").withColumn("num", F.when(F.col("l_partkey") % 7 == 0, F.col("num") + 1).otherwise(F.col("num") * 1.001))
    return audit.confusion(rows.drop("l_partkey"), got.drop("l_partkey"))


# order tables with squeezed cells, line feeds, made-up names and a note as last row
_PLANTED = f"""{CELLS_SQL}, planted AS (SELECT table_id, row_idx, col_idx, CASE WHEN table_id % 4 = 1 AND col_idx = 0 THEN 'rows 12.50 and ' || row_idx || ' were read' WHEN table_id % 4 = 0 AND col_idx = 3 THEN text || chr(10) || 'x' ELSE text END AS text FROM order_cells
  UNION ALL SELECT table_id, n, c, CASE WHEN c = 0 THEN 'Note: all values are those of the order' ELSE '' END FROM (SELECT table_id, max(row_idx) + 1 AS n FROM order_cells WHERE table_id % 2 = 0 GROUP BY 1) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) k(c))"""


def _planted(spark, d):
    cells, m = order_cells(spark, d), F.col("table_id") % 4
    text = F.when((m == 1) & (F.col("col_idx") == 0), F.concat(F.lit("rows 12.50 and "), F.col("row_idx"), F.lit(" were read"))).when((m == 0) & (F.col("col_idx") == 3), F.concat("text", F.lit("\nx"))).otherwise(F.col("text"))
    notes = cells.where("table_id % 2 = 0").groupBy("table_id").agg((F.max("row_idx") + 1).alias("row_idx")).select("table_id", "row_idx", F.posexplode(F.array(F.lit("Note: all values are those of the order"), *[F.lit("")] * 4)).alias("col_idx", "text"))
    heads = order_headers(spark, d).withColumn("name", F.when(F.col("table_id") % 3 == 0, F.concat(F.lit("Col_"), F.col("col_idx") + 1)).otherwise(F.col("name")))
    return cells.withColumn("text", text).unionByName(notes), heads


@query("q54_audit_dimensions", f"""WITH {_PLANTED}, c AS (SELECT table_id, row_idx, col_idx, text, trim(text, ' ') AS s FROM planted), m AS (SELECT *, regexp_matches(s, '^[<>]?[-+]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') OR regexp_matches(s, '^[0-9]+(\\.[0-9]+)? *[±~～-] *[0-9]+(\\.[0-9]+)?$') AS num, lower(s) NOT IN ('', 'nan', 'none', '-') AS has,
  len(list_filter(string_split_regex(s, '\\s+'), lambda x: regexp_matches(x, '^-?[0-9]+(\\.[0-9]+)?$'))) AS numbers FROM c),
t AS (SELECT table_id, count(*) FILTER (num AND has) AS numeric_cells, count(*) FILTER (has AND NOT num AND length(s) > 20 AND numbers >= 2) AS squeezed_cells, count(*) FILTER (contains(text, chr(10))) AS multiline_cells, table_id % 3 = 0 AS unnamed,
  round(1 - count(*) FILTER (lower(s) NOT IN ('', 'nan', 'none')) / ((max(row_idx) + 1) * 5), 6) AS sparsity, arg_max(CASE WHEN col_idx = 0 THEN text END, row_idx) LIKE 'Note:%' AS footnote_embedded FROM m GROUP BY 1)
SELECT *, unnamed::INT::BIGINT + (squeezed_cells > 0)::INT::BIGINT + footnote_embedded::INT::BIGINT AS anomalies FROM t""")
def q54(spark, d):
    return audit.table_dimensions(*_planted(spark, d)).withColumn("sparsity", F.round("sparsity", 6))


@query("q55_audit_report", """WITH d AS (SELECT o_orderkey, c_mktsegment, count(l_orderkey) AS n, coalesce(sum(CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END), 0) AS anomalies FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
s AS (SELECT c_mktsegment, CASE WHEN n = 0 THEN 2 WHEN n < 2 THEN 1 ELSE 0 END AS missing, anomalies, 100 - least(40, 15 * CASE WHEN n = 0 THEN 2 WHEN n < 2 THEN 1 ELSE 0 END) - CASE WHEN o_orderkey % 4 = 0 THEN 10 ELSE 0 END - least(30, 5 * anomalies) AS score FROM d),
b AS (SELECT *, CASE WHEN score >= 95 AND anomalies = 0 THEN 'pass' WHEN score >= 85 THEN 'high' ELSE 'low' END AS band FROM s)
SELECT c_mktsegment, count(*) AS n_docs, round(avg(score), 4) AS mean_score, count(*) FILTER (band = 'pass') AS n_pass, count(*) FILTER (band = 'high') AS n_high, count(*) FILTER (band = 'low') AS n_low, sum(missing)::BIGINT AS n_missing, sum(anomalies)::BIGINT AS n_anomalies FROM b GROUP BY ROLLUP (c_mktsegment)""")
def q55(spark, d):
    o, c, li = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_partkey") % 13 == 0).alias("anomalies"))
    docs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(per, "o_orderkey", "left").na.fill(0, ["n", "anomalies"])
    docs = docs.select("c_mktsegment", F.when(F.col("n") == 0, 2).when(F.col("n") < 2, 1).otherwise(0).alias("missing"), (F.col("o_orderkey") % 4 != 0).alias("has_manifest"), "anomalies")
    return audit.report(audit.document_scores(docs), "c_mktsegment")


@query("q56_numbering_gaps", """WITH n AS (SELECT DISTINCT o_custkey AS doc_id, o_orderpriority AS chapter, (o_orderkey % 30)::BIGINT AS number FROM orders), l AS (SELECT *, lead(number) OVER (PARTITION BY doc_id, chapter ORDER BY number) AS nx FROM n)
SELECT doc_id, chapter, unnest(generate_series(number + 1, nx - 1)) AS missing_number FROM l WHERE nx - number > 1""")
def q56(spark, d):
    return audit.numbering_gaps(read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("chapter"), (F.col("o_orderkey") % 30).alias("number")))


@query("q59_catalog_eav", "SELECT c_custkey AS item_id, c_name AS title, c_mktsegment AS publication, c_nationkey::VARCHAR AS place FROM customer")
def q59(spark, d):
    c = read(spark, d, "customer")
    long = c.select("c_custkey", F.posexplode(F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("unused"))).alias("field_id", "value"))
    values = long.select("value").distinct().select("value", F.xxhash64("value").alias("value_id"))
    data = long.join(values, "value").select(F.col("c_custkey").alias("item_id"), "field_id", "value_id")
    fields = spark.createDataFrame([(0, "title"), (1, "publication"), (2, "place"), (3, "extra")], "field_id int, field_name string")
    return catalog.pivot_fields(data, values, fields, ["title", "publication", "place"])


@query("q60_resume_antijoin", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) * 10.0 >= 30)")
def q60(spark, d):
    done = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) * 10.0).alias("score"))
    return catalog.todo(read(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey", recheck_below=30)


# squeezed columns as in q20, names made up by a parser for every third table, and a blank fourth column for every fifth
@query("q64_quality_gate", f"""WITH {_SQUEEZED_CTE}, w AS (SELECT table_id, row_idx, col_idx, text FROM cells UNION ALL SELECT table_id, row_idx, 3, CASE WHEN table_id % 5 = 0 THEN '' ELSE 'x' END FROM base),
f AS (SELECT table_id, count(*) FILTER (lower(trim(text, ' ')) NOT IN ('', 'nan', 'none')) / (max(row_idx + 1) * 4) < 0.5 AS g1 FROM w GROUP BY 1), b AS (SELECT table_id, bool_or(e) AS g4 FROM (SELECT table_id, col_idx, bool_and(lower(trim(text, ' ')) IN ('', 'nan', 'none')) AS e FROM w GROUP BY 1, 2) GROUP BY 1), q AS (SELECT table_id, bool_or(squeezed) AS g3 FROM sq GROUP BY 1)
SELECT table_id, g1 AS g1_sparse, table_id % 3 = 0 AS g2_unnamed, coalesce(g3, false) AS g3_squeezed, g4 AS g4_blank_columns, g1::INT::BIGINT + (table_id % 3 = 0)::INT::BIGINT + coalesce(g3, false)::INT::BIGINT + g4::INT::BIGINT AS n_alarms FROM f JOIN b USING (table_id) LEFT JOIN q USING (table_id)""")
def q64(spark, d):
    cells = _squeezed_cells(spark, d).select("table_id", "row_idx", "col_idx", "text")
    fourth = cells.where("col_idx = 0").select("table_id", "row_idx", F.lit(3).alias("col_idx"), F.when(F.col("table_id") % 5 == 0, "").otherwise("x").alias("text"))
    heads = cells.select("table_id").distinct().select("table_id", F.posexplode(F.array(*[F.when(F.col("table_id") % 3 == 0, f"Unnamed: {k}").otherwise(n) for k, n in enumerate(("Sample", "Qty", "Price", "Flag"))])).alias("col_idx", "name"))
    return profile.quality_gate(cells.unionByName(fourth), heads)


@query("q65_low_quality", f"""WITH {CELLS_SQL}, c AS (SELECT table_id, row_idx, col_idx, CASE WHEN table_id % 6 = 0 AND col_idx IN (1, 2, 3, 4) THEN '' WHEN table_id % 6 = 1 AND col_idx > 2 THEN '' ELSE text END AS text FROM order_cells),
k AS (SELECT table_id, col_idx, count(*) FILTER (lower(trim(text)) NOT IN ('', 'nan', 'none')) AS n, count(*) AS r, max(regexp_matches(text, '[0-9]')::INT) AS dg FROM c GROUP BY 1, 2), s AS (SELECT table_id, sum(n) / sum(r) AS ratio, max(r) AS nr, count(*) AS nc, count(*) FILTER (n = 0) AS bl, max(dg) AS dg FROM k GROUP BY 1)
SELECT table_id, CASE WHEN nr >= 3 AND nc >= 3 AND ratio < 0.25 AND NOT (dg = 1 AND ratio >= 0.08) THEN 'sparse' WHEN nc > 3 AND bl >= 2 THEN 'empty_columns' ELSE 'ok' END AS reason FROM s""")
def q65(spark, d):
    m, c = F.col("table_id") % 6, F.col("col_idx")
    text = F.when((m == 0) & (c >= 1), "").when((m == 1) & (c > 2), "").otherwise(F.col("text"))
    return profile.low_quality(order_cells(spark, d).withColumn("text", text))
