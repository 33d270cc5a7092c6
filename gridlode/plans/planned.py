"""Queries on catalogs, evaluation and names; inputs are planted by key arithmetic where the tables hold nothing of the kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import arbitrate, boxes, catalog, classify, evaluate, geometry, ledger
from ..sources import markdown, sinks
from ..session import spread
from .fixtures import CELLS_SQL, ROWS_SQL, order_cells, order_headers, order_rows, read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_FILES = "SELECT l_orderkey AS item_id, 'f' || l_partkey || CASE l_suppkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.html' END AS path FROM lineitem"


def _files(spark, d):
    end = F.when(F.col("l_suppkey") % 3 == 0, ".pdf").when(F.col("l_suppkey") % 3 == 1, ".PDF").otherwise(".html")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("f"), F.col("l_partkey"), end).alias("path"))


@query("q81_pdf_attachments", f"SELECT o_orderkey AS item_id, o_orderstatus AS status, path FROM orders JOIN ({_FILES}) f ON item_id = o_orderkey WHERE path ILIKE '%.pdf'")
def q81(spark, d):
    return catalog.pdf_attachments(read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status")), _files(spark, d))


@query("q82_parent_items", """WITH f AS (SELECT o_orderkey AS file_id, 'K' || o_custkey AS key, 'N' || (o_orderkey % 500) AS name FROM orders), k AS (SELECT 'K' || c_custkey AS key, min(c_nationkey) AS p FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), n AS (SELECT 'N' || s_suppkey AS name, min(s_nationkey) + 100 AS p FROM supplier GROUP BY 1)
SELECT file_id, f.key, f.name, coalesce(k.p, n.p, -1) AS parent_id FROM f LEFT JOIN k ON f.key = k.key LEFT JOIN n ON f.name = n.name""")
def q82(spark, d):
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("K"), F.col("o_custkey")).alias("key"), F.concat(F.lit("N"), F.col("o_orderkey") % 500).alias("name"))
    keys = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("K"), F.col("c_custkey")).alias("key"), F.col("c_nationkey").alias("parent_id"))
    names = read(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_suppkey")).alias("name"), (F.col("s_nationkey") + 100).alias("parent_id"))
    return catalog.parent_items(files, keys, names).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)))


_AUDITS = "a AS (SELECT o_orderkey AS doc_id, o_custkey % 3 AS n_declared, count(l_orderkey) FILTER (l_partkey % 4 = 0) AS n_extracted, (o_orderkey * 37) % 101 AS score FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 4)"


def _audits(spark, d):
    found = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_partkey") % 4 == 0).alias("n_extracted"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 3).alias("n_declared"), (F.col("o_orderkey") * 37 % 101).alias("score")).join(found, "doc_id", "left").na.fill(0, ["n_extracted"]).select("doc_id", "n_declared", "n_extracted", "score")


@query("q83_audited_with_tables", f"WITH {_AUDITS} SELECT * FROM a WHERE n_declared > 0 OR n_extracted > 0")
def q83(spark, d):
    return catalog.audited_with_tables(_audits(spark, d))


@query("q84_quality_ascending", f"WITH {_AUDITS} SELECT * FROM a ORDER BY score, doc_id")
def q84(spark, d):
    return catalog.worst_first(_audits(spark, d))


@query("q85_low_score_picks", f"WITH {_AUDITS} SELECT * FROM a WHERE score < 85 ORDER BY score, doc_id LIMIT 10")
def q85(spark, d):
    return catalog.worst_first(_audits(spark, d), n=10, below=85)


@query("q86_target_list", f"WITH {_AUDITS} SELECT doc_id FROM a WHERE n_declared > 0 OR n_extracted > 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def q86(spark, d):
    return catalog.target_list(_audits(spark, d), read(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id")))


_PATHS = ("storage:a b.pdf", "attachments:sub/c.pdf", "file:///x/d.pdf", "/plain/e.pdf")


@query("q87_attachment_paths", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/store/K' || c_custkey || '/a b.pdf' WHEN 1 THEN '/base/sub/c.pdf' WHEN 2 THEN '/x/d.pdf' ELSE '/plain/e.pdf' END AS path FROM customer")
def q87(spark, d):
    raw = F.get(F.array(*[F.lit(p) for p in _PATHS]), (F.col("c_custkey") % 4).cast("int"))
    return read(spark, d, "customer").select("c_custkey", catalog.attachment_path(raw, F.concat(F.lit("K"), F.col("c_custkey")), "/store/", "/base/").alias("path"))


@query("q88_cell_matches", """WITH b AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) % 6 AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem))
SELECT k, count(*) AS n, count(*) FILTER (CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE false END) AS n_right FROM b GROUP BY 1""")
def q88(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").distinct()
    # numbered within the orders first, so that no window holds the whole table
    per = rows.groupBy("l_orderkey").count()
    before = per.withColumn("bucket", F.floor(F.col("l_orderkey") / 1000))
    sums = before.groupBy("bucket").agg(F.sum("count").alias("c")).withColumn("start", F.sum("c").over(Window.orderBy("bucket")) - F.col("c"))
    starts = before.join(sums, "bucket").withColumn("first", F.col("start") + F.sum("count").over(Window.partitionBy("bucket").orderBy("l_orderkey")) - F.col("count")).select("l_orderkey", "first")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = rows.withColumn("nth", nth).join(starts, "l_orderkey").withColumn("k", (F.col("first") + F.col("nth")) % 6)
    raw = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    texts = [raw, F.concat(F.lit("about "), raw, F.lit(" wt%")), F.concat(F.lit(" "), raw, F.lit(" ")), (F.col("l_extendedprice") * 1.005).cast("decimal(18,4)").cast("string"), (F.col("l_extendedprice") * 1.03 + 1).cast("decimal(18,2)").cast("string"), F.lit("n.d.")]
    got = F.get(F.array(*texts), F.col("k").cast("int"))
    return rows.select("k", evaluate.cell_matches(got, F.col("l_extendedprice"), raw).alias("ok")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_right"))


@query("q89_column_map", """SELECT p_partkey AS table_id, w AS want_idx, CASE WHEN w = 0 THEN 2 WHEN w = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END WHEN w = 2 THEN 2 ELSE -1 END AS got_idx, CASE WHEN w = 0 THEN 'name' WHEN w = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'leaf' ELSE 'place' END WHEN w = 2 THEN 'place' ELSE 'none' END AS how FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) k(w)""")
def q89(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("table_id"), "p_brand")
    truth = p.select("table_id", F.posexplode(F.array(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" $")), F.lit("Info_Spot"), F.lit("Mass"), F.lit("Extra"))).alias("col_idx", "name"))
    found = p.select("table_id", F.posexplode(F.array(F.when(F.col("table_id") % 2 == 0, "Sample_SPOT").otherwise("x"), F.lit("Y"), F.lower("p_brand"))).alias("col_idx", "name"))
    return evaluate.column_map(truth, found).withColumn("got_idx", F.coalesce("got_idx", F.lit(-1)))


@query("q90_extraction_errors", f"""WITH {ROWS_SQL}, g AS (SELECT table_id // 4 AS doc_id, table_id, count(*) AS n_rows, count(*) FILTER (l_partkey % 7 = 0) AS n_wrong FROM order_rows GROUP BY 1, 2),
m AS (SELECT *, table_id % 9 = 0 AS gone, CASE WHEN table_id % 4 = 1 THEN 1 ELSE 0 END AS cut FROM g)
SELECT doc_id, count(*) AS n_tables, count(*) FILTER (gone) AS missed, sum(CASE WHEN gone THEN n_rows ELSE cut END)::BIGINT AS truncated_rows, sum(n_rows)::BIGINT AS n_cells, sum(CASE WHEN gone THEN n_rows ELSE n_wrong END)::BIGINT AS n_wrong, count(*) FILTER (NOT gone AND cut = 1 AND table_id % 3 = 0) AS false_agreements, round(sum(CASE WHEN gone THEN n_rows ELSE n_wrong END) / sum(n_rows), 6) AS value_error FROM m GROUP BY 1""")
def q90(spark, d):
    rows = order_rows(spark, d).groupBy(F.floor(F.col("table_id") / 4).alias("doc_id"), "table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_partkey") % 7 == 0).alias("n_wrong")).withColumn("n_cells", F.col("n_rows"))
    found = rows.where("table_id % 9 <> 0").select("doc_id", "table_id", (F.col("n_rows") - F.when(F.col("table_id") % 4 == 1, 1).otherwise(0)).alias("n_rows"))
    return evaluate.extraction_errors(rows, found, found.where("table_id % 3 = 0"))


@query("q91_match_tables", """WITH l AS (SELECT DISTINCT l_orderkey // 8 AS doc_id, l_orderkey % 8 AS k FROM lineitem) SELECT doc_id, k AS truth_id, (k + 1) % 8 AS found_id, 0.9::DOUBLE AS score FROM l WHERE (doc_id + k) % 3 <> 0""")
def q91(spark, d):
    tables = read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8).alias("truth_id")).distinct()
    # each truth has one good table, for some too bad a one; all would take table 99 if it were better
    good = tables.select("doc_id", "truth_id", ((F.col("truth_id") + 1) % 8).alias("found_id"), F.when((F.col("doc_id") + F.col("truth_id")) % 3 == 0, 0.3).otherwise(0.9).alias("score"))
    return evaluate.match_tables(good.union(tables.select("doc_id", "truth_id", F.lit(99), F.lit(0.2))))


@query("q92_metric_report", """SELECT r_regionkey AS region, '| nation | customers |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || c || ' |', chr(10) ORDER BY n_name) AS report FROM region JOIN (SELECT n_regionkey, n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) ON n_regionkey = r_regionkey GROUP BY 1""")
def q92(spark, d):
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    rows = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("customers"))
    return evaluate.markdown_report(rows, ["nation", "customers"], "region")


@query("q93_group_attributes", "SELECT o_custkey AS group_id, min(o_orderkey % 40) AS page_idx, array_to_string(list_sort(list_distinct(list(o_orderkey % 40))), ',') AS covered_pages, count(*) AS n_parts FROM orders GROUP BY 1")
def q93(spark, d):
    return evaluate.group_attributes(read(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 40).alias("page_idx"))).withColumn("covered_pages", F.array_join(F.col("covered_pages").cast("array<string>"), ","))


@query("q94_custom_headers", "SELECT DISTINCT l_orderkey AS table_id, k AS col_idx, CASE k WHEN 0 THEN 'Key' WHEN 1 THEN 'Amount' ELSE 'Col' || k END AS name FROM lineitem CROSS JOIN (VALUES (0), (1), (2), (3), (4)) c(k)")
def q94(spark, d):
    return evaluate.custom_headers(order_headers(spark, d), ["Key", "Amount"])


@query("q95_first_tables", "SELECT o_custkey AS doc_id, min(o_orderkey) AS table_idx FROM orders GROUP BY 1")
def q95(spark, d):
    return evaluate.select_tables(read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_idx")), "first")


@query("q96_page_of_table", """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) SELECT doc_id, k AS table_idx, CASE WHEN k % 3 = 0 THEN 'Table ' || k ELSE '' END AS label, CASE WHEN k % 3 = 0 THEN k * 2 ELSE (SELECT x.k * 2 FROM c x WHERE x.doc_id = c.doc_id AND x.place = c.place) END AS page_idx FROM c""")
def q96(spark, d):
    c = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_idx"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Table "), F.col("o_orderkey"))).otherwise("").alias("label"))
    captions = c.select("doc_id", (F.col("table_idx") * 2).alias("page_idx"), F.lit(0).alias("line_no"), F.when(F.col("table_idx") % 3 == 0, F.col("label")).otherwise(F.concat(F.lit("Plate "), F.col("table_idx"))).alias("label"))
    return evaluate.page_of_table(c, captions)


@query("q97_subset_pages", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey % 7 AS page_idx, o_orderkey AS table_idx FROM orders), w AS (SELECT *, max(page_idx) OVER (PARTITION BY doc_id) >= 6 AS whole FROM o) SELECT doc_id, table_idx, CASE WHEN doc_id % 2 = 0 OR whole THEN page_idx ELSE page_idx * 10 + 3 END AS page_idx FROM w""")
def q97(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("page_idx"), F.col("o_orderkey").alias("table_idx"))
    subsets = o.where("doc_id % 2 = 1").select("doc_id").distinct().withColumn("pages", F.array(*[F.lit(10 * k + 3).cast("long") for k in range(6)]))
    return evaluate.subset_pages(o, subsets)


@query("q98_area_ratio", "SELECT p_partkey AS pair_id, CASE WHEN p_partkey % 5 = 0 THEN 'inf' ELSE round(greatest(p_size * 2.0, 30.0) / least(p_size * 2.0, 30.0), 6)::DOUBLE::VARCHAR END AS ratio FROM part")
def q98(spark, d):
    box = lambda w, h: F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), (w + 1.0).alias("x1"), (h + 1.0).alias("y1"))
    pairs = read(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), box(F.col("p_size"), F.lit(2.0)).alias("a"), F.when(F.col("p_partkey") % 5 != 0, box(F.lit(5.0), F.lit(6.0))).alias("b"))
    ratio = evaluate.area_ratio("a", "b")
    return pairs.select("pair_id", F.when(ratio == float("inf"), "inf").otherwise(F.round(ratio, 6).cast("string")).alias("ratio"))


@query("q99_table_tokens", f"""WITH {CELLS_SQL}, n AS (SELECT DISTINCT table_id, unnest(['sample', 'qty', 'price', '(usd)', 'flag', 'code']) AS token FROM order_rows), c AS (SELECT table_id, unnest(string_split_regex(lower(text), '[\\s/|,;]+')) AS token FROM order_cells WHERE lower(trim(text)) NOT IN ('nan', 'none', 'null'))
SELECT table_id, count(DISTINCT token) AS n_tokens, sum(DISTINCT length(token))::BIGINT AS lengths, max(token) AS last FROM (SELECT * FROM n UNION SELECT * FROM c WHERE token <> '') GROUP BY 1""")
def q99(spark, d):
    tokens = evaluate.table_tokens(order_cells(spark, d), order_headers(spark, d))
    return tokens.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum_distinct(F.length("token")).cast("long").alias("lengths"), F.max("token").alias("last"))


@query("q100_degraded_matches", "SELECT p_partkey AS pair_id, p_size % 6 AS n_back, (p_size % 6 >= 3 AND (floor(p_retailprice)::BIGINT % 100) / 100.0 >= 0.55) OR (p_size % 6 >= 3 AND (p_partkey % 100) / 100.0 >= 0.65) OR (p_partkey % 2 = 0 AND p_size % 6 >= 3 AND greatest((floor(p_retailprice)::BIGINT % 100) / 100.0, (p_partkey % 100) / 100.0) >= 0.50) AS matches FROM part")
def q100(spark, d):
    n = F.col("p_size") % 6
    price = F.floor("p_retailprice").cast("long")
    pairs = read(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), n.alias("n_forth"), (price % 100 / 100.0).alias("forth"), n.alias("n_back"), (F.col("p_partkey") % 100 / 100.0).alias("back"), (F.col("p_partkey") % 2 == 0).alias("same_label"))
    return evaluate.degraded_matches(pairs).select("pair_id", "n_back", "matches")


@query("q101_index_rows", "SELECT p_partkey AS table_id, 0 AS row_idx FROM part WHERE p_partkey % 5 IN (0, 3)")
def q101(spark, d):
    k = F.col("p_partkey") % 5
    first = F.when(k == 0, F.array(F.lit("(1)"), F.lit("2"), F.lit("3.0"))).when(k == 1, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).when(k == 2, F.array(F.lit("(1)"), F.lit("(3)"), F.lit("(4)"))).when(k == 3, F.array(F.lit("[0]"), F.lit("[1]"), F.lit("[ 2 ]"))).otherwise(F.array(F.lit("(1)"), F.lit(""), F.lit("(3)")))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.lit(0).alias("row_idx"), F.posexplode(first).alias("col_idx", "text"))
    return evaluate.index_rows(rows.unionByName(rows.withColumn("row_idx", F.lit(1)).withColumn("text", F.lit("(1)"))))


@query("q102_probed_names", "SELECT p_partkey AS table_id, k AS col_idx, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'A_1' WHEN 2 THEN 'A_2' WHEN 3 THEN 'Col_4' ELSE p_brand END AS name FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4)) c(k)")
def q102(spark, d):
    return evaluate.names_with_probing(read(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.posexplode(F.array(F.lit("A"), F.lit("A_1"), F.lit("A"), F.lit(" "), F.col("p_brand"))).alias("col_idx", "name")))


@query("q103_label_collisions", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, o_orderkey // 1000 AS page_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT doc_id, table_idx, CASE WHEN n = 1 THEN 'keep' WHEN table_idx % 7 = 0 THEN 'combine' WHEN page_idx - k // 1000 >= 2 THEN 'page_name' WHEN (table_idx % 2) <> (k % 2) THEN 'version' WHEN table_idx % 50 > k % 50 OR (table_idx % 50 = k % 50 AND table_idx % 3 > k % 3) THEN 'replace' ELSE 'drop' END AS action FROM o""")
def q103(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    tables = o.select(F.col("o_custkey").alias("doc_id"), F.lit("Table 1").alias("label"), k.alias("table_idx"), F.floor(k / 1000).alias("page_idx"), (k % 7 == 0).alias("is_continuation"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("d"), F.lit("e"))).alias("columns"), (k % 50).alias("cells"), (k % 3).alias("priority"))
    return evaluate.label_collisions(tables).select("doc_id", "table_idx", "action")


@query("q104_race_winner", """WITH l AS (SELECT l_orderkey AS doc_id, 's' || l_suppkey % 5 AS source, bool_or(l_suppkey % 5 = 0) AS authoritative, sum(l_partkey % 3) AS n_tables, min(l_partkey) AS arrived FROM lineitem GROUP BY 1, 2) SELECT doc_id, arg_min(source, (CASE WHEN authoritative THEN 0 ELSE 1 END, -n_tables, arrived, source)) AS source FROM l WHERE n_tables > 0 GROUP BY 1""")
def q104(spark, d):
    answers = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("source")).agg(F.max(F.col("l_suppkey") % 5 == 0).alias("authoritative"), F.sum(F.col("l_partkey") % 3).alias("n_tables"), F.min("l_partkey").alias("arrived"))
    return arbitrate.first_answer(answers, ["doc_id"])


@query("q105_inherited_labels", """WITH c AS (SELECT o_custkey AS cluster_id, o_orderkey AS priority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Table ' || o_orderkey END AS label, o_orderkey % 2 = 0 AS fb FROM orders)
SELECT cluster_id, priority, coalesce(arg_min(label, priority) FILTER (NOT fb AND label <> '') OVER w, arg_min(label, priority) FILTER (label <> '') OVER w) AS cluster_label FROM c WINDOW w AS (PARTITION BY cluster_id)""")
def q105(spark, d):
    k = F.col("o_orderkey")
    c = read(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"), k.alias("priority"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Table "), k)).alias("label"), (k % 2 == 0).alias("label_is_fallback"))
    return arbitrate.inherit_labels(c, ["cluster_id"]).select("cluster_id", "priority", "cluster_label")


@query("q106_captions_by_ordinal", """WITH tb AS (SELECT o_custkey AS doc_id, o_orderkey % 6 AS page_idx, o_orderkey AS table_idx FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY table_idx) AS nth FROM tb), l AS (SELECT *, CASE WHEN page_idx % 2 = 0 AND nth = 1 THEN 'Table ' || page_idx END AS own FROM n),
b AS (SELECT *, last_value(CASE WHEN own IS NOT NULL THEN struct_pack(l := own, p := page_idx) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_idx, table_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT doc_id, page_idx, table_idx, coalesce(own, CASE WHEN page_idx - before.p <= 3 THEN before.l END) AS label, own IS NULL AND coalesce(page_idx - before.p <= 3, false) AS is_continuation FROM b""")
def q106(spark, d):
    tables = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("page_idx"), F.col("o_orderkey").alias("table_idx"))
    captions = tables.where("page_idx % 2 = 0").select("doc_id", "page_idx").distinct().withColumn("line_no", F.lit(3)).withColumn("label", F.concat(F.lit("Table "), F.col("page_idx")))
    return ledger.captions_by_ordinal(tables, captions)


@query("q107_file_names", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, o_orderkey % 4 AS page_idx, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Table ' || (o_orderkey % 2) END AS label FROM orders), b AS (SELECT *, CASE WHEN label = '' THEN 'Table ' || row_number() OVER (PARTITION BY doc_id, label = '' ORDER BY page_idx, table_idx) ELSE label END AS base FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY page_idx, table_idx) AS n, row_number() OVER (PARTITION BY doc_id, base, page_idx ORDER BY table_idx) AS s FROM b) SELECT doc_id, table_idx, CASE WHEN n = 1 THEN base WHEN s = 1 THEN base || '_p' || (page_idx + 1) ELSE base || '_p' || (page_idx + 1) || '_v' || s END AS file_name FROM n""")
def q107(spark, d):
    k = F.col("o_orderkey")
    tables = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("table_idx"), (k % 4).alias("page_idx"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Table "), k % 2)).alias("label"))
    return sinks.file_names(tables).select("doc_id", "table_idx", "file_name")


@query("q108_merged_rows", f"""WITH {CELLS_SQL} SELECT table_id, max(row_idx) <= 2 AND count(*) FILTER (table_id % 3 = 0 AND col_idx < 2) > 0.30 * count(*) AS merged FROM order_cells GROUP BY 1""")
def q108(spark, d):
    cells = order_cells(spark, d)
    return classify.merged_rows(cells.withColumn("text", F.when((F.col("table_id") % 3 == 0) & (F.col("col_idx") < 2), F.concat(F.lit("a\n"), "text")).otherwise(F.col("text"))))


@query("q109_truncated_online", f"""WITH {CELLS_SQL}, m AS (SELECT *, max(row_idx) OVER (PARTITION BY table_id) AS last FROM order_cells), c AS (SELECT table_id, row_idx, col_idx, CASE WHEN table_id % 4 = 0 AND row_idx = last THEN CASE WHEN col_idx = 0 THEN 'See full table online' ELSE '' END WHEN table_id % 4 = 1 AND col_idx > 0 THEN '' ELSE text END AS text FROM m)
SELECT table_id, count(*) FILTER (trim(text, ' ') <> '') < 4 OR count(*) FILTER (trim(text, ' ') <> '') < 0.25 * count(*) OR table_id % 4 = 0 AS truncated FROM c GROUP BY 1""")
def q109(spark, d):
    from pyspark.sql import Window

    cells = order_cells(spark, d).withColumn("last", F.max("row_idx").over(Window.partitionBy("table_id")))
    k = F.col("table_id") % 4
    text = F.when((k == 0) & (F.col("row_idx") == F.col("last")), F.when(F.col("col_idx") == 0, "See full table online").otherwise("")).when((k == 1) & (F.col("col_idx") > 0), "").otherwise(F.col("text"))
    return classify.truncated_online(cells.withColumn("text", text).drop("last"))


@query("q110_layout_shell", "SELECT c_custkey AS table_id, c_custkey % 5 IN (0, 1) AS shell FROM customer")
def q110(spark, d):
    rows = read(spark, d, "customer").withColumnRenamed("c_custkey", "table_id").withColumn("k", F.col("table_id") % 5)
    text = F.when(F.col("k") == 0, F.repeat(F.lit("word "), 20)).when(F.col("k") == 1, "Download PDF").when(F.col("k") == 2, "short").when(F.col("k") == 3, "View all").otherwise("Menu")
    first = rows.select("table_id", F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), text.alias("text"))
    second = rows.where("k = 3").select("table_id", F.lit(0).alias("row_idx"), F.lit(1).alias("col_idx"), F.lit("x").alias("text"))
    labels = rows.select("table_id", F.when(F.col("k") == 4, "Table 1").otherwise("").alias("label"))
    return classify.layout_shell(first.unionByName(second), labels)


@query("q111_wrapped_references", "SELECT c_custkey AS doc_id, 1::BIGINT AS line_no, c_custkey % 5 IN (0, 1, 3) AS wrapped FROM customer")
def q111(spark, d):
    k = F.col("c_custkey") % 5
    above = F.when(k == 0, "as shown in").when(k == 1, "this line of the body goes on and on without an end").when(k == 2, "a short line").when(k == 3, F.repeat(F.lit("text of the body. "), 9)).otherwise("this line of the body is long and ends here, too.")
    lines = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(above, F.when(k == 0, "Table 3. a").otherwise("Table 3"))).alias("line_no", "line"))
    return classify.wrapped_references(lines).where("line_no = 1").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "wrapped")


@query("q112_split_pages", "SELECT doc_id, 0 AS page_idx, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT doc_id, 6, count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def q112(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("first\n"), F.when(F.col("doc_id") % 2 == 0, "<!-- page 7 -->\nsecond").otherwise("")).alias("text"))
    return markdown.split_pages(docs).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))


@query("q113_has_table", "SELECT doc_id, doc_id % 4 IN (0, 1) AS has_table FROM documents")
def q113(spark, d):
    k = F.col("doc_id") % 4
    end = F.when(k == 0, "\n<TABLE border=1>").when(k == 1, "\n| a | b |\n|---|:-:|\n| 1 | 2 |").when(k == 2, "\n| a | b |").otherwise("")
    return read(spark, d, "documents").select("doc_id", markdown.has_table(F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[|<]", " "), end)).alias("has_table"))


@query("q114_page_ranges", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(range(c_custkey % 5, c_custkey % 5 + 3), [c_custkey % 11]))), ',') AS pages FROM customer")
def q114(spark, d):
    a, b = F.col("c_custkey") % 5 + 1, F.col("c_custkey") % 11 + 1
    text = F.concat_ws("", a.cast("string"), F.lit("-"), (a + 2).cast("string"), F.lit(", x, "), b.cast("string"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(t.parse_page_ranges(text).cast("array<string>"), ",").alias("pages"))


@query("q115_full_text_urls", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://doi.org/10.1234/x' || c_custkey WHEN 1 THEN 'https://pubs.acs.org/doi/full/10.1/' || c_custkey ELSE 'https://a.org/doi/abs/' || c_custkey END AS url FROM customer")
def q115(spark, d):
    k, key = F.col("c_custkey") % 3, F.col("c_custkey")
    raw = F.when(k == 0, F.concat(F.lit(" https://10.1234/x"), key)).when(k == 1, F.concat(F.lit("https://pubs.acs.org/doi/abs/10.1/"), key)).otherwise(F.concat(F.lit("https://a.org/doi/abs/"), key))
    return read(spark, d, "customer").select("c_custkey", t.full_text_url(raw).alias("url"))


@query("q116_normalised_boxes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size / 100.0 * 600 WHEN 1 THEN p_size / 1000.0 * 600 ELSE p_size * 1.0 END AS x0, CASE p_partkey % 3 WHEN 0 THEN 0.9 * 800 WHEN 1 THEN 0.9 * 800 ELSE 900.0 END AS y1 FROM part")
def q116(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    rows = read(spark, d, "part").select("p_partkey", F.when(k == 0, size / 100.0).otherwise(size * 1.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(k == 0, 0.95).otherwise(950.0).alias("x1"), F.when(k == 0, 0.9).otherwise(900.0).alias("y1"), F.when(k == 1, "norm_1000").otherwise("points").alias("bbox_format"))
    return boxes.normalise(rows, F.lit(600.0), F.lit(800.0)).select("p_partkey", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query("q117_rotated_words", "SELECT p_partkey, (p_size * 2.0)::DOUBLE AS x0, (600 - p_size - 10.0)::DOUBLE AS y0, (p_size * 2.0 + 5)::DOUBLE AS x1, (600 - p_size)::DOUBLE AS y1 FROM part")
def q117(spark, d):
    size = F.col("p_size")
    words = read(spark, d, "part").select("p_partkey", (size * 1.0).alias("x0"), (size * 2.0).alias("y0"), (size + 10.0).alias("x1"), (size * 2.0 + 5.0).alias("y1"))
    return geometry.rotate(words, 90, 600.0, 800.0)


@query("q118_labels_by_form", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Table III' WHEN 1 THEN 'Table ' || p_size WHEN 2 THEN '表2.' || p_size WHEN 3 THEN '附表4' WHEN 4 THEN 'Table ' || p_size || 'A' WHEN 5 THEN 'Table A-' || p_size WHEN 6 THEN 'Supplementary Table S' || p_size ELSE '' END AS label, p_partkey % 8 IN (3, 6) AS supplementary FROM part""")
def q118(spark, d):
    k, n = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    raw = F.when(k == 0, "TABLE III").when(k == 1, F.concat(F.lit("Tab. "), n, F.lit(". Title"))).when(k == 2, F.concat(F.lit("表 2."), n)).when(k == 3, "附表 4").when(k == 4, F.concat(F.lit("table "), n, F.lit("A: Results"))).when(k == 5, F.concat(F.lit("Table A-"), n)).when(k == 6, F.concat(F.lit("Supplementary  Table S"), n)).otherwise("")
    return read(spark, d, "part").select("p_partkey", t.canonical_label(raw).alias("label"), t.is_supplementary(raw).alias("supplementary"))


@query("q119_expected_labels", """SELECT c_custkey AS doc_id, 'Table ' || n AS label, (n - 1) * 2 AS first_line, CASE WHEN n = 1 THEN 2 ELSE 1 END AS n_lines FROM customer CROSS JOIN (VALUES (1), (2)) k(n)""")
def q119(spark, d):
    lines = F.array(F.lit("Table 1. Ages"), F.lit("text"), F.lit("TABLE 2: Mass"), F.lit("表1 年龄"))
    rows = spread(read(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "line")).withColumn("is_caption", F.col("line") != "text")
    return evaluate.expected_labels(rows).select("doc_id", "label", "first_line", "n_lines")
