"""Queries that relate tables to one another: merges, ledgers, fragments, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, boxes, ledger, merge
from .fixtures import ROWS_SQL, order_rows, read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("q31_complementary_merge", """WITH p AS (SELECT c_nationkey AS pair_id, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_nationkey AS pair_id, c_custkey, c_acctbal::DECIMAL(18,2)::VARCHAR AS bal FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT c_nationkey AS pair_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_nationkey % 5 <> 4 GROUP BY 1)
SELECT p.pair_id, '0' || c_custkey AS sample, c_mktsegment AS segment, coalesce((SELECT bal FROM s JOIN r USING (pair_id) WHERE s.pair_id = p.pair_id AND s.c_custkey = p.c_custkey), '') AS balance FROM p
UNION ALL SELECT s.pair_id, '+0' || c_custkey, NULL, bal FROM s JOIN r USING (pair_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pair_id = s.pair_id AND p.c_custkey = s.c_custkey)""")
def q31(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_nationkey", "pair_id")
    primary = c.where("c_custkey % 3 <> 0").select("pair_id", F.concat(F.lit("0"), F.col("c_custkey")).alias("sample"), F.col("c_mktsegment").alias("segment"))
    secondary = c.where("c_custkey % 2 = 0").select("pair_id", F.concat(F.lit("+0"), F.col("c_custkey")).alias("sample"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"))
    twice = secondary.where("pair_id % 5 = 4")  # keys that repeat: these pairs are refused
    return merge.complementary(primary, secondary.unionByName(twice), "sample", ["balance"])


@query("q32_horizontal_merge", """WITH l AS (SELECT c_nationkey AS pair_id, c_custkey::VARCHAR AS key, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT c_nationkey AS pair_id, c_custkey::VARCHAR AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.key, r.key) AS key, segment, name FROM l FULL JOIN r ON l.pair_id = r.pair_id AND l.key = r.key""")
def q32(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("pair_id"), F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return merge.horizontal(c.where("cast(key as long) % 3 <> 0").select("pair_id", "key", "segment"), c.where("cast(key as long) % 2 = 0").select("pair_id", "key", "name"), "segment", "name")


_VERSIONS = f"""{ROWS_SQL}, a AS (SELECT table_id AS pair_id, row_idx AS sample, 'qty' AS field, l_quantity::DECIMAL(18,2)::VARCHAR AS value FROM order_rows), b AS (SELECT table_id AS pair_id, row_idx AS sample, 'qty' AS field, CASE WHEN l_partkey % 7 = 0 THEN (l_quantity + 1)::DECIMAL(18,2)::VARCHAR ELSE l_quantity::DECIMAL(18,2)::VARCHAR END AS value FROM order_rows WHERE (l_partkey + row_idx) % 5 <> 0)"""


@query("q33_conflict_versions", f"""WITH {_VERSIONS}, f AS (SELECT a.pair_id, a.sample, a.value AS va, b.value AS vb FROM a JOIN b USING (pair_id, sample, field)),
c AS (SELECT pair_id, count(*) AS shared, count(*) FILTER (va <> vb) AS conflicts FROM f GROUP BY 1),
m AS (SELECT pair_id, least(va, vb) AS x, greatest(va, vb) AS y, count(*) FILTER (va < vb) AS up, count(*) FILTER (va > vb) AS down FROM f WHERE va <> vb GROUP BY 1, 2, 3), s AS (SELECT pair_id, sum(least(up, down)) AS swaps FROM m GROUP BY 1),
n AS (SELECT pair_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT pair_id, count(*) AS nb FROM b GROUP BY 1),
o AS (SELECT pair_id, coalesce(shared, 0) AS shared, coalesce(conflicts, 0) AS conflicts, coalesce(swaps, 0)::BIGINT AS swaps, coalesce(shared, 0) / greatest(1, least(na, coalesce(nb, 0))) AS overlap FROM n LEFT JOIN nb USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN s USING (pair_id))
SELECT pair_id, shared, conflicts, swaps, round(overlap, 6) AS overlap, overlap < 0.4 OR swaps > 0 OR conflicts >= 2 OR conflicts >= greatest(0.15 * shared, 1e-9) AS distinct_version FROM o""")
def q33(spark, d):
    rows = order_rows(spark, d)
    qty = lambda c: c.cast("decimal(18,2)").cast("string")
    a = rows.select(F.col("table_id").alias("pair_id"), F.col("row_idx").alias("sample"), F.lit("qty").alias("field"), qty(F.col("l_quantity")).alias("value"))
    b = rows.where("(l_partkey + row_idx) % 5 <> 0").select(F.col("table_id").alias("pair_id"), F.col("row_idx").alias("sample"), F.lit("qty").alias("field"), qty(F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).alias("value"))
    return merge.conflict(a, b).withColumn("overlap", F.round("overlap", 6))


@query("q34_online_pdf_match", f"""WITH {ROWS_SQL}, l AS (SELECT DISTINCT l_orderkey // 4 AS doc_id, l_orderkey AS id, (l_orderkey % 4) // 2 AS page_idx, CASE WHEN l_orderkey % 3 = 0 THEN 'Table ' || (l_orderkey % 4) ELSE '' END AS label FROM lineitem),
r AS (SELECT doc_id, id, page_idx, CASE WHEN id % 3 = 0 THEN 'Table ' || (id % 4) ELSE '' END AS label FROM l), cl AS (SELECT l_orderkey AS id, l_partkey AS value FROM lineitem), cr AS (SELECT l_orderkey AS id, l_partkey AS value FROM lineitem WHERE l_partkey % 5 <> 0),
bl AS (SELECT l.doc_id, l.id AS left_id, min(r.id) AS right_id FROM l JOIN r ON l.doc_id = r.doc_id AND l.label = r.label AND l.label <> '' GROUP BY 1, 2), b AS (SELECT doc_id, right_id, min(left_id) AS left_id FROM bl GROUP BY 1, 2),
a1 AS (SELECT DISTINCT doc_id, page_idx, id AS left_id, value FROM l JOIN cl USING (id) WHERE id NOT IN (SELECT left_id FROM b)), b1 AS (SELECT DISTINCT doc_id, page_idx, id AS right_id, value FROM r JOIN cr USING (id) WHERE id NOT IN (SELECT right_id FROM b)),
g AS (SELECT doc_id, left_id, right_id, count(*) AS n FROM a1 JOIN b1 USING (doc_id, page_idx, value) GROUP BY 1, 2, 3), na AS (SELECT left_id, count(*) AS na FROM a1 GROUP BY 1), nb AS (SELECT right_id, count(*) AS nb FROM b1 GROUP BY 1),
good AS (SELECT g.* FROM g JOIN na USING (left_id) JOIN nb USING (right_id) WHERE n >= 2 AND n >= 0.25 * least(na, nb)), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left_id ORDER BY n DESC, right_id) AS i, row_number() OVER (PARTITION BY doc_id, right_id ORDER BY n DESC, left_id) AS j FROM good)
SELECT doc_id, left_id, right_id, 'label' AS how FROM b UNION ALL SELECT doc_id, left_id, right_id, 'content' FROM w WHERE i = 1 AND j = 1""")
def q34(spark, d):
    rows = read(spark, d, "lineitem")
    label = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Table "), F.col("id") % 4)).otherwise("")
    left = rows.select(F.expr("l_orderkey div 4").alias("doc_id"), F.col("l_orderkey").alias("id"), F.expr("(l_orderkey % 4) div 2").alias("page_idx")).distinct().withColumn("label", label)
    values = rows.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("value"))
    return merge.match_tables(left, left, values, values.where("value % 5 <> 0"))


@query("q35_missing_tables", """SELECT o_custkey AS doc_id, 'Table ' || o_orderkey AS label, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def q35(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    declared = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("Table "), F.col("o_orderkey")).alias("label"), "o_orderstatus")
    extracted = o.join(li.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("Table "), F.col("o_orderkey")).alias("label"))
    return ledger.missing_tables(declared, extracted)


@query("q35b_completeness", """WITH d AS (SELECT o_custkey AS doc_id, count(*) AS n_declared FROM orders GROUP BY 1), e AS (SELECT o_custkey AS doc_id, count(*) AS n_extracted FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT doc_id, n_declared, coalesce(n_extracted, 0) AS n_extracted, round(least(1.0, coalesce(n_extracted, 0)::DOUBLE / n_declared), 4) AS recall FROM d LEFT JOIN e USING (doc_id)""")
def q35b(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    declared = o.select(F.col("o_custkey").alias("doc_id"))
    return ledger.completeness(declared, o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("doc_id")))


@query("q36_numeric_gate", f"""WITH {ROWS_SQL}, t AS (SELECT table_id, CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS number FROM order_rows UNION ALL SELECT table_id, l_extendedprice FROM order_rows WHERE l_suppkey % 2 = 0),
p AS (SELECT table_id, l_quantity AS number FROM order_rows UNION ALL SELECT table_id, l_extendedprice FROM order_rows WHERE table_id % 3 <> 0), a AS (SELECT table_id, number, count(*) AS a FROM t GROUP BY 1, 2), b AS (SELECT table_id, number, count(*) AS b FROM p GROUP BY 1, 2),
j AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.table_id = b.table_id AND a.number = b.number), s AS (SELECT table_id, sum(a)::BIGINT AS n_table, sum(b)::BIGINT AS n_page, sum(least(a, b))::BIGINT AS matched FROM j GROUP BY 1)
SELECT *, round(matched / greatest(1, n_table), 6) AS precision, round(matched / greatest(1, n_page), 6) AS recall, CASE WHEN n_table = 0 OR n_page = 0 THEN 'unverified' WHEN matched / greatest(1, n_table) >= 0.7 AND matched / greatest(1, n_page) >= 0.5 THEN 'passed' ELSE 'failed' END AS status FROM s""")
def q36(spark, d):
    rows = order_rows(spark, d)
    shifted = F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    table = rows.select("table_id", shifted.alias("number")).unionByName(rows.where("l_suppkey % 2 = 0").select("table_id", F.col("l_extendedprice").alias("number")))
    page = rows.select("table_id", F.col("l_quantity").alias("number")).unionByName(rows.where("table_id % 3 <> 0").select("table_id", F.col("l_extendedprice").alias("number")))
    return ledger.numeric_gate(table, page)


_FRAGMENTS = f"""{ROWS_SQL}, frag AS (SELECT DISTINCT table_id AS doc_id, CASE WHEN row_idx < 3 THEN 0 ELSE 1 END AS seq FROM order_rows),
f AS (SELECT doc_id, seq, seq AS page_idx, CASE WHEN seq = 0 OR doc_id % 4 = 0 THEN 'Table ' || (doc_id % 97) ELSE '' END AS label, CASE WHEN seq = 1 AND doc_id % 3 = 0 THEN 2 ELSE 3 END AS ncols, seq = 1 AND doc_id % 4 = 1 AS cont, CASE WHEN seq = 1 AND doc_id % 5 = 0 THEN false ELSE true END AS same FROM frag)"""


def _fragments(spark, d):
    frag = order_rows(spark, d).select(F.col("table_id").alias("doc_id"), F.when(F.col("row_idx") < 3, 0).otherwise(1).alias("seq")).distinct()
    label = F.when((F.col("seq") == 0) | (F.col("doc_id") % 4 == 0), F.concat(F.lit("Table "), F.col("doc_id") % 97)).otherwise("")
    other, short, full = (F.array(*[F.lit(x) for x in c]) for c in (("X", "Y", "Z"), ("Sample", "Qty (ppm)"), ("Sample", "Qty", "Price")))
    cols = F.when((F.col("seq") == 1) & (F.col("doc_id") % 5 == 0), other).when((F.col("seq") == 1) & (F.col("doc_id") % 3 == 0), short).otherwise(full)
    return frag.select("doc_id", "seq", F.col("seq").alias("page_idx"), label.alias("label"), cols.alias("columns"), ((F.col("seq") == 1) & (F.col("doc_id") % 4 == 1)).alias("is_continuation"))


@query("q37_continuation_groups", f"""WITH {_FRAGMENTS}, g AS (SELECT doc_id, seq, CASE WHEN seq = 0 THEN 1 WHEN doc_id % 4 = 0 THEN 0 WHEN NOT same THEN 1 ELSE 0 END AS brk FROM f)
SELECT doc_id, seq, sum(brk) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS group_no FROM g""")
def q37(spark, d):
    return align.continuation_groups(_fragments(spark, d)).select("doc_id", "seq", "group_no")


@query("q38_stitch", f"""WITH {ROWS_SQL}, c AS (SELECT table_id AS group_id, row_idx, l_partkey, l_quantity::DECIMAL(18,2)::VARCHAR AS qty FROM order_rows)
SELECT group_id, row_idx::BIGINT AS row_idx, k.name AS "column", CASE k.name WHEN 'sample' THEN 'S-' || l_partkey ELSE qty END AS text FROM c CROSS JOIN (VALUES ('sample'), ('qty')) k(name) WHERE NOT (k.name = 'qty' AND row_idx >= 3 AND group_id % 3 = 0)""")
def q38(spark, d):
    rows = order_rows(spark, d)
    part = F.when(F.col("row_idx") < 3, 0).otherwise(1)
    cell = lambda n, v: F.struct(F.lit(n).alias("column"), v.alias("text"))
    later = F.when(part == 1, "Qty (ppm)").otherwise("QTY")
    cells = rows.select((F.col("table_id") * 2 + part).alias("table_id"), (F.col("row_idx") - part * 3).alias("row_idx"), (F.col("table_id") % 3).alias("m"), part.alias("p"), F.explode(F.array(cell("Sample", F.concat(F.lit("S-"), F.col("l_partkey"))), F.struct(later.alias("column"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("text")))).alias("c"))
    cells = cells.select("table_id", "row_idx", "m", "p", "c.column", "c.text").where("not (lower(column) like 'qty%' and p = 1 and m = 0)")
    groups = cells.select("table_id").distinct().select("table_id", F.expr("table_id div 2").alias("group_id"), (F.col("table_id") % 2).alias("seq"))
    return align.stitch(cells.select("table_id", "row_idx", "column", "text"), groups)


@query("q39_column_align")
def q39(spark, d):
    parts = read(spark, d, "part")
    left = parts.select(F.col("p_partkey").alias("pair_id"), F.posexplode(F.array(*[F.lit(x) for x in ("Sample", "Qty (ppm)", "Price", "Flag")])).alias("col_idx", "name"))
    right = parts.select(F.col("p_partkey").alias("pair_id"), F.posexplode(F.array(F.lit("sample"), F.lit("Price"), F.col("p_brand"))).alias("col_idx", "name"))
    ratio = F.when(F.col("name").rlike("Qty|Price"), 1.0).otherwise(0.0)
    add = lambda df, n: df.withColumn("num_ratio", ratio).withColumn("n_cols", F.lit(n))
    return align.align_columns(align.column_scores(add(left, 4), add(right, 3))).withColumn("score", F.round("score", 6))


def _boxes(spark, d):
    p = read(spark, d, "part")
    x0, y0 = (F.col("p_partkey") * 37 % 500).cast("double"), (F.col("p_size") * 14).cast("double")
    base = p.select((F.col("p_partkey") % 200).alias("page"), F.col("p_partkey").alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 90 + F.col("p_size")).alias("x1"), (y0 + 60).alias("y1"), F.col("p_retailprice").alias("score"))
    jitter = (F.col("box_id") % 5 * 6).cast("double")
    truth = base.where("box_id % 2 = 0").select("page", "box_id", (F.col("x0") + jitter).alias("x0"), (F.col("y0") + jitter).alias("y0"), (F.col("x1") + jitter).alias("x1"), (F.col("y1") + jitter).alias("y1"))
    return base, truth


_BOXES = """base AS (SELECT p_partkey % 200 AS page, p_partkey AS box_id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_size * 14)::DOUBLE AS y0, (p_partkey * 37 % 500)::DOUBLE + 90 + p_size AS x1, (p_size * 14)::DOUBLE + 60 AS y1, p_retailprice AS score FROM part),
truth AS (SELECT page, box_id, x0 + box_id % 5 * 6 AS x0, y0 + box_id % 5 * 6 AS y0, x1 + box_id % 5 * 6 AS x1, y1 + box_id % 5 * 6 AS y1 FROM base WHERE box_id % 2 = 0),
meet AS (SELECT a.page, a.box_id AS a_id, b.box_id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, a.score
  FROM base a JOIN truth b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""


@query("q40_iou_pairs", f"WITH {_BOXES} SELECT page, a_id, b_id, round(i / (aa + ab - i), 6) AS iou, round(i / least(aa, ab), 6) AS iom FROM meet")
def q40(spark, d):
    base, truth = _boxes(spark, d)
    return boxes.overlap_pairs(base, truth, ["page"]).select("page", "a_id", "b_id", F.round("iou", 6).alias("iou"), F.round("iom", 6).alias("iom"))


@query("q41_average_precision", f"""WITH {_BOXES}, h AS (SELECT b.page, b.box_id, b.score, max(CASE WHEN m.b_id = b.box_id AND i / (aa + ab - i) >= 0.5 THEN 1 ELSE 0 END) AS tp FROM base b LEFT JOIN meet m ON m.a_id = b.box_id GROUP BY 1, 2, 3),
r AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS k, tp FROM h), n AS (SELECT page, count(*) AS n_truth FROM truth GROUP BY 1),
u AS (SELECT r.*, n_truth, sum(tp) OVER w / n_truth AS rec, sum(tp) OVER w / k AS prec FROM r JOIN n USING (page) WINDOW w AS (PARTITION BY page ORDER BY k)), e AS (SELECT *, max(prec) OVER (PARTITION BY page ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, rec - coalesce(lag(rec) OVER (PARTITION BY page ORDER BY k), 0) AS step FROM u),
s AS (SELECT page, count(*) AS n_pred, max(n_truth) AS n_truth, sum(tp) AS tp, sum(step * env) AS ap FROM e GROUP BY 1)
SELECT page, n_pred, n_truth, round(tp / n_pred, 6) AS precision, round(tp / n_truth, 6) AS recall, round(2 * (tp / n_pred) * (tp / n_truth) / greatest(1e-6, tp / n_pred + tp / n_truth), 6) AS f1, round(ap, 6) AS ap FROM s""")
def q41(spark, d):
    base, truth = _boxes(spark, d)
    same = boxes.overlap_pairs(base, truth, ["page"]).where("a_id = b_id and iou >= 0.5").select(F.col("a_id").alias("box_id"), F.lit(1).alias("tp"))
    from pyspark.sql import Window

    hits = base.join(same, "box_id", "left").na.fill(0, ["tp"]).withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.col("score").desc(), "box_id")))
    return boxes.average_precision(hits.select("page", "rank", "tp"), truth.groupBy("page").agg(F.count(F.lit(1)).alias("n_truth")), ["page"])


@query("q42_map_5095")
def q42(spark, d):
    base, truth = _boxes(spark, d)
    steps = [round(0.50 + 0.05 * i, 2) for i in range(10)]
    from pyspark.sql import Window

    hits = boxes.greedy_hits(base, truth, ["page"], steps)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("threshold", "page").orderBy(F.col("score").desc(), "box_id")))
    n = truth.groupBy("page").agg(F.count(F.lit(1)).alias("n_truth")).crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in steps], "threshold double")))
    ap = boxes.average_precision(hits, n, ["threshold", "page"])
    return ap.groupBy("page").agg(F.round(F.avg("ap"), 6).alias("map_5095"), F.round(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))), 6).alias("ap_50"), F.round(F.max(F.when(F.col("threshold") == 0.75, F.col("ap"))), 6).alias("ap_75"))


@query("q43_caption_assign", f"""WITH {_BOXES}, cap AS (SELECT page, box_id, x0, y0 - 30 AS y0, x0 + 80 AS x1, y0 - 12 AS y1 FROM base WHERE box_id % 3 = 0),
f AS (SELECT c.page, c.box_id AS caption_id, b.box_id, greatest(b.y0 - c.y1, c.y0 - b.y1, 0) AS gap FROM cap c JOIN base b ON b.page = c.page WHERE least(b.x1, c.x1) - greatest(b.x0, c.x0) >= 0.2 * least(b.x1 - b.x0, c.x1 - c.x0) AND greatest(b.y0 - c.y1, c.y0 - b.y1, 0) <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY page, caption_id ORDER BY gap, box_id) AS k FROM f) SELECT page, caption_id, box_id, gap FROM r WHERE k = 1""")
def q43(spark, d):
    base, _ = _boxes(spark, d)
    cap = base.where("box_id % 3 = 0").select("page", "box_id", "x0", (F.col("y0") - 30).alias("y0"), (F.col("x0") + 80).alias("x1"), (F.col("y0") - 12).alias("y1"))
    return boxes.assign_captions(base, cap, ["page"])


@query("q44_ensemble_boxes", f"""WITH {_BOXES}, one AS (SELECT *, box_id % 3 = 0 AS cap FROM base WHERE box_id % 4 <> 3), two AS (SELECT page, box_id, x0, y0, x1, y1, (box_id % 10)::DOUBLE AS score, box_id % 4 = 0 AS cap FROM truth),
m AS (SELECT a.page, a.box_id AS a_id, b.box_id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM one a JOIN two b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
g AS (SELECT *, i / (aa + ab - i) AS iou, i / least(aa, ab) AS iom FROM m), p AS (SELECT page, b_id, a_id, row_number() OVER (PARTITION BY page, b_id ORDER BY iou DESC, a_id) AS k FROM g WHERE iou >= 0.4 OR (iou >= 0.25 AND iom >= 0.7)),
u AS (SELECT p.page, p.a_id AS box_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score, bool_or(cap) AS cap FROM p JOIN two ON two.page = p.page AND two.box_id = p.b_id WHERE k = 1 GROUP BY 1, 2)
SELECT 'first' AS origin, one.page, one.box_id, least(one.x0, coalesce(u.x0, one.x0)) AS x0, least(one.y0, coalesce(u.y0, one.y0)) AS y0, greatest(one.x1, coalesce(u.x1, one.x1)) AS x1, greatest(one.y1, coalesce(u.y1, one.y1)) AS y1, greatest(one.score, coalesce(u.score, one.score)) AS score, one.cap OR coalesce(u.cap, false) AS has_caption FROM one LEFT JOIN u USING (page, box_id)
UNION ALL SELECT 'second', page, box_id, x0, y0, x1, y1, score, cap FROM two WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = two.page AND p.b_id = two.box_id)""")
def q44(spark, d):
    base, truth = _boxes(spark, d)
    one = base.where("box_id % 4 <> 3").withColumn("has_caption", F.col("box_id") % 3 == 0)
    two = truth.withColumn("score", (F.col("box_id") % 10).cast("double")).withColumn("has_caption", F.col("box_id") % 4 == 0)
    return boxes.ensemble(one, two, ["page"])


@query("q45_nms")
def q45(spark, d):
    base, truth = _boxes(spark, d)
    both = base.select("page", "box_id", "x0", "y0", "x1", "y1", "score", (F.col("box_id") % 2).alias("kind")).unionByName(truth.select("page", (F.col("box_id") + 10_000_000).alias("box_id"), "x0", "y0", "x1", "y1", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("kind")))
    return boxes.suppress(both, ["page"]).select("page", "box_id", "kind", "score")


@query("q57_page_islands", """WITH p AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 40)::INT AS page_idx FROM orders), i AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS i FROM p),
r AS (SELECT doc_id, i, min(page_idx) AS a, max(page_idx) AS b FROM i GROUP BY 1, 2) SELECT doc_id, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (b + 1) END, ',' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def q57(spark, d):
    return align.format_page_ranges(read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 40).cast("int").alias("page_idx")))


@query("q58_angle_distribution", """WITH v AS (SELECT p_partkey % 50 AS page, CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN -1 WHEN 2 THEN -12 ELSE 2 END AS dx, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 3 ELSE -20 END AS dy, length(p_name) AS chars FROM part),
a AS (SELECT page, (((round(degrees(atan2(dy, dx)) / 90) * 90)::INT % 360) + 360) % 360 AS angle, chars FROM v) SELECT page, angle, sum(chars)::BIGINT AS chars FROM a GROUP BY 1, 2""")
def q58(spark, d):
    m = F.col("p_size") % 4
    dx = F.when(m == 0, 10).when(m == 1, -1).when(m == 2, -12).otherwise(2)
    dy = F.when(m == 0, 1).when(m == 1, 9).when(m == 2, 3).otherwise(-20)
    v = read(spark, d, "part").select((F.col("p_partkey") % 50).alias("page"), boxes.snap_angle(dx, dy).alias("angle"), F.length("p_name").alias("chars"))
    return v.groupBy("page", "angle").agg(F.sum("chars").alias("chars"))


@query("q61_keep_latest", """SELECT event_type, user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2""")
def q61(spark, d):
    e = read(spark, d, "events")
    return merge.latest(e.select("event_type", "user_id", "event_id", "value", "ts"), ["event_type", "user_id"], F.struct("ts", "event_id")).drop("ts")
