"""Queries on pages, documents and markup, and what leaves the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.matching import block_ratio, scored_pairs
from ..operators import classify, cleaning, geometry, ledger, profile
from ..sources import files, markdown, markup, sinks
from ..streaming.ingest import event_counts
from .fixtures import CELLS_SQL, ROWS_SQL, order_cells, order_headers, order_rows, read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("q10_markdown_scan", f"""WITH {ROWS_SQL} SELECT table_id AS doc_id, 1::BIGINT AS table_no, (table_id % 5)::INT AS page_idx, 'Table ' || (table_id % 97) AS label, (row_idx + 1)::BIGINT AS row_idx, c.col_idx, CASE c.col_idx WHEN 0 THEN l_partkey::VARCHAR ELSE l_returnflag END AS text FROM order_rows CROSS JOIN (VALUES (0), (1)) c(col_idx)
UNION ALL SELECT DISTINCT table_id, 1, (table_id % 5)::INT, 'Table ' || (table_id % 97), 0, c.col_idx, CASE c.col_idx WHEN 0 THEN 'Part' ELSE 'Flag' END FROM order_rows CROSS JOIN (VALUES (0), (1)) c(col_idx)""")
def q10(spark, d):
    rows = order_rows(spark, d)
    line = F.concat(F.lit("| "), F.col("l_partkey"), F.lit(" | "), F.col("l_returnflag"), F.lit(" |"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", line.alias("l")))), lambda r: r["l"]), "\n")
    docs = rows.groupBy(F.col("table_id").alias("doc_id")).agg(body.alias("body"))
    head = F.concat(F.lit("Intro\n<!-- Page "), F.col("doc_id") % 5 + 1, F.lit(" -->\nTable "), F.col("doc_id") % 97, F.lit(". Orders\n| Part | Flag |\n|---|:-:|\n"))
    cells = markdown.scan_markdown(docs.select("doc_id", F.concat(head, "body", F.lit("\nend")).alias("text")))
    return cells.select("doc_id", F.col("table_no").cast("long").alias("table_no"), "page_idx", "label", F.col("row_idx").cast("long").alias("row_idx"), "col_idx", "text")


@query("q11_page_filter", r"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw FROM documents), n AS (SELECT *, trim(raw) AS line FROM l),
k AS (SELECT *, length(regexp_replace(' ' || line, '[^A-Za-z_0-9.+-][+-]?[0-9]+(\.[0-9]+)?', chr(1), 'g')) - length(replace(regexp_replace(' ' || line, '[^A-Za-z_0-9.+-][+-]?[0-9]+(\.[0-9]+)?', chr(1), 'g'), chr(1), '')) AS nums FROM n)
SELECT doc_id, count(*) FILTER (contains(line, chr(9)) OR length(line) - length(replace(line, '|', '')) >= 2) AS tabular_lines FROM k GROUP BY 1""")
def q11(spark, d):
    return profile.pages_with_tables(read(spark, d, "documents")).select("doc_id", "tabular_lines")


@query("q11b_pages_may_contain_tables")
def q11b(spark, d):
    return profile.pages_with_tables(read(spark, d, "documents"))


@query("q13_caption_declarations", """WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, o_orderkey % 6 AS k, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)
SELECT doc_id, line_no, k IN (0, 4) AS is_caption, bool_or(k = 3 AND line_no >= 0.6 * last) OVER (PARTITION BY doc_id ORDER BY line_no) AS in_references,
  CASE WHEN k < 3 THEN 'Table ' || line_no WHEN k = 4 THEN '表' || line_no ELSE '' END AS label FROM l""")
def q13(spark, d):
    o = read(spark, d, "orders")
    n = F.col("o_orderkey") % 6
    line = F.when(n == 0, F.concat(F.lit("Table "), F.col("o_orderkey"), F.lit(". Orders of a customer"))).when(n == 1, F.concat(F.lit("Table "), F.col("o_orderkey"), F.lit(" shows the orders, and more."))).when(n == 2, F.concat(F.lit("Table "), F.col("o_orderkey"), F.lit(" ........ 12"))).when(n == 3, "References").when(n == 4, F.concat(F.lit("表 "), F.col("o_orderkey"), F.lit(" 订单"))).otherwise("Plain text")
    lines = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return ledger.references_section(profile.caption_lines(lines)).select("doc_id", "line_no", "is_caption", "in_references", t.canonical_label(t.find_label(F.col("line"))).alias("label"))


# every page's own link, and one at a known or hostile place for each
_PLANTED_URLS = ("https://www.sciencedirect.com/a.pdf?x=1", "https://kns.cnki.net/x", "https://link.springer.com/book.PDF#p", "HTTP://ONLINELIBRARY.WILEY.COM/y.pdf.html", "no link", "https://www.nature.com/z", "https://linkinghub.elsevier.com/r")


@query("q14_url_publisher", rf"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -1 - page_id, ({list(_PLANTED_URLS)})[1 + page_id % {len(_PLANTED_URLS)}] FROM pages), h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), '\.pdf$') AS is_pdf FROM u)
SELECT page_id, host, CASE WHEN host = '' THEN 'none' WHEN host LIKE '%cnki.%' THEN 'cnki' WHEN host LIKE '%sciencedirect.com%' OR host LIKE '%elsevier.com%' THEN 'elsevier' WHEN host LIKE '%springer%' OR host LIKE '%nature.com%' THEN 'springer' WHEN host LIKE '%wiley.com%' THEN 'wiley' ELSE 'general' END AS publisher, is_pdf FROM h""")
def q14(spark, d):
    pages, u = read(spark, d, "pages").select("page_id", "url"), F.col("url")
    planted = pages.select((-1 - F.col("page_id")).alias("page_id"), F.get(F.array(*[F.lit(x) for x in _PLANTED_URLS]), (F.col("page_id") % len(_PLANTED_URLS)).cast("int")).alias("url"))
    return pages.unionByName(planted).select("page_id", t.host(u).alias("host"), t.publisher(u).alias("publisher"), t.looks_like_pdf(u).alias("is_pdf"))


@query("q15_ids", """SELECT o_orderkey, (1000 + o_orderkey % 9000) || '.' || (10000 + o_custkey % 90000) AS arxiv, 'PMC' || (100000 + o_orderkey) AS pmc, '10.' || (1000 + o_custkey % 9000) || '/x' || o_orderkey AS doi, (1900 + o_orderkey % 200)::INT AS year FROM orders""")
def q15(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    new = F.concat(1000 + k % 9000, F.lit("."), 10000 + c % 90000)
    raw = F.when(k % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), new)).when(k % 3 == 1, F.concat(F.lit("see arXiv: "), new)).otherwise(F.concat(F.lit("10.48550/arXiv."), new))
    pmc = F.concat(F.lit("in pmc"), 100000 + k, F.lit(" there"))
    doi = F.concat(F.lit("https://doi.org/10."), 1000 + c % 9000, F.lit("/x"), k, F.lit("."))
    years = F.concat(F.lit("Published "), 1900 + k % 200, F.lit(" and 2099"))
    return read(spark, d, "orders").select("o_orderkey", t.arxiv_id(raw).alias("arxiv"), t.pmc_id(pmc).alias("pmc"), t.doi(doi).alias("doi"), F.when(k % 200 < 200, t.year(years)).alias("year"))


_MARKERS = ("verify you are human", "checking your browser", "captcha", "access denied", "enable javascript and cookies")


@query("q16_antibot_class", "SELECT page_id, lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) IN ('sciencedirect', 'cloudflare', 'error', '403', 'page not found', 'security verification') OR regexp_matches(lower(substr(html, 1, 12000)), 'verify you are human|checking your browser|captcha|access denied|enable javascript and cookies') AS blocked FROM pages")
def q16(spark, d):
    title = F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    start = F.lower(F.substring("html", 1, 12000))  # the rule looks at the head of a page only
    return read(spark, d, "pages").select("page_id", (title.isin("sciencedirect", "cloudflare", "error", "403", "page not found", "security verification") | start.rlike("|".join(_MARKERS))).alias("blocked"))


@query("q17_boilerplate_stats", r"""SELECT page_id, length(html)::BIGINT AS chars, length(regexp_replace(html, '(?is)<(script|style|nav|footer|header|form)\b[^>]*>.*?</(script|style|nav|footer|header|form)>', '', 'g'))::BIGINT AS kept_chars,
  length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header|form)\b[^>]*>.*?</(script|style|nav|footer|header|form)>', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')))::BIGINT AS text_chars FROM pages""")
def q17(spark, d):
    kept = F.regexp_replace("html", r"(?is)<(script|style|nav|footer|header|form)\b[^>]*>.*?</(script|style|nav|footer|header|form)>", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(kept, "<[^>]*>", " "), r"\s+", " "))
    return read(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("chars"), F.length(kept).cast("long").alias("kept_chars"), F.length(plain).cast("long").alias("text_chars"))


@query("q29_html_tables")
def q29(spark, d):
    p = read(spark, d, "part")
    html = F.concat(F.lit("<p>x<table><caption>Table "), F.col("p_partkey") % 50, F.lit(". Parts</caption><tr><th rowspan=2>Id<th colspan=2>Size</tr><tr><th>a<th>b</tr><tr><td>"), F.col("p_partkey"), F.lit("<td>10<sup>2</sup><td>"), F.col("p_size"), F.lit("</table>"))
    return markup.scan_html(p.select(F.col("p_partkey").alias("doc_id"), html.alias("html"))).drop("footnotes")


@query("q30_jats_cals")
def q30(spark, d):
    p = read(spark, d, "part")
    xml = F.concat(F.lit('<article><table-wrap><label>Table 1</label><caption><p>Parts</p></caption><table><thead><tr><th>Id</th><th>Size</th></tr></thead><tbody><tr><td rowspan="2">'), F.col("p_partkey"), F.lit("</td><td>"), F.col("p_size"), F.lit("</td></tr><tr><td>n.d.</td></tr></tbody></table><table-wrap-foot><fn>n.d., none</fn></table-wrap-foot></table-wrap></article>"))
    return markup.scan_xml(p.select(F.col("p_partkey").alias("doc_id"), xml.alias("xml"))).withColumn("footnotes", F.array_join("footnotes", "; "))


@query("q30b_archive_tables", """SELECT p_partkey AS doc_id, 1 AS item_no, (p_size)::INT AS page_idx, 'Table ' || p_size AS caption, '<table><tr><td>' || p_partkey || '</td></tr></table>' AS html FROM part""")
def q30b(spark, d):
    p = read(spark, d, "part")
    j = F.concat(F.lit('[{"type":"text","text":"x"},{"type":"table","page_idx":'), F.col("p_size"), F.lit(',"table_caption":["Table '), F.col("p_size"), F.lit('"],"table_body":"<table><tr><td>'), F.col("p_partkey"), F.lit('</td></tr></table>"}]'))
    return files.archive_tables(p.select(F.col("p_partkey").alias("doc_id"), j.alias("json"))).select("doc_id", "item_no", "page_idx", "caption", "html")


@query("q61b_words_to_grid")
def q61b(spark, d):
    rows = order_rows(spark, d)
    word = lambda i, c: F.struct(F.lit(40.0 + 90 * i).alias("x0"), F.col(c).cast("string").alias("text"))
    words = rows.select(F.col("table_id").alias("doc_id"), "row_idx", F.explode(F.array(word(0, "l_partkey"), word(1, "l_suppkey"), word(2, "l_returnflag"))).alias("w"))
    words = words.select("doc_id", F.col("w.x0").alias("x0"), (F.col("row_idx") * 12.0 + F.col("w.x0") % 3).alias("y0"), (F.col("w.x0") + 30).alias("x1"), F.col("w.text").alias("text"))
    return geometry.words_to_grid(words, ["doc_id"])


@query("q62_manifest", """WITH t AS (SELECT o_custkey AS doc_id, 'Table ' || (o_orderkey % 25) AS label, o_orderkey % 25 AS n, o_orderpriority || ' ' || o_orderstatus AS title FROM orders), b AS (SELECT doc_id, label, any_value(n) AS n, arg_max(title, struct_pack(n := length(title), t := title)) AS title FROM t GROUP BY 1, 2)
SELECT doc_id, label, title, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS position FROM b""")
def q62(spark, d):
    o = read(spark, d, "orders")
    return sinks.manifest(o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("Table "), F.col("o_orderkey") % 25).alias("label"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title")))


@query("q63_preview_cards", f"""WITH {CELLS_SQL}, s AS (SELECT table_id, row_idx, col_idx, '<td>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td>' AS td FROM order_cells WHERE row_idx < 15),
r AS (SELECT table_id, row_idx, '<tr>' || string_agg(td, '' ORDER BY col_idx) || '</tr>' AS tr FROM s GROUP BY 1, 2) SELECT table_id, '<table>' || string_agg(tr, '' ORDER BY row_idx) || '</table>' AS html FROM r GROUP BY 1""")
def q63(spark, d):
    return sinks.preview_cards(order_cells(spark, d))


@query("q63b_column_widths", f"WITH {CELLS_SQL} SELECT table_id, col_idx, least(50, greatest(10, max(length(text)) + 3))::BIGINT AS width FROM order_cells WHERE row_idx < 200 GROUP BY 1, 2")
def q63b(spark, d):
    return sinks.column_widths(order_cells(spark, d))


@query("q66_events_windowed", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q66(spark, d):
    """Extension: the streaming aggregation, run on the table."""
    return event_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("q67_paywall", f"""WITH {CELLS_SQL}, c AS (SELECT table_id, row_idx, CASE WHEN table_id % 5 = 0 AND row_idx = 0 AND col_idx = 0 THEN 'Please accept cookies' WHEN table_id % 5 = 1 AND row_idx = 0 AND col_idx < 2 THEN CASE col_idx WHEN 0 THEN 'Login here' ELSE 'or subscribe' END WHEN table_id % 5 = 2 AND row_idx = 0 AND col_idx = 0 THEN 'different parent' ELSE text END AS text FROM order_cells)
SELECT table_id, max(row_idx) + 1 <= 4 AND table_id % 5 IN (0, 1) AS paywall FROM c GROUP BY 1""")
def q67(spark, d):
    m, r, c = F.col("table_id") % 5, F.col("row_idx"), F.col("col_idx")
    text = F.when((m == 0) & (r == 0) & (c == 0), "Please accept cookies").when((m == 1) & (r == 0) & (c == 0), "Login here").when((m == 1) & (r == 0) & (c == 1), "or subscribe").when((m == 2) & (r == 0) & (c == 0), "different parent").otherwise(F.col("text"))
    return profile.paywall_tables(order_cells(spark, d).withColumn("text", text))


@query("q68_metadata_tables")
def q68(spark, d):
    c, m = F.col("col_idx"), F.col("table_id") % 6
    text = F.when(m == 0, F.when(c == 0, F.concat(F.lit("["), F.col("row_idx") + 1, F.lit("] Smith et al."))).otherwise("2001")).when(m == 1, "This is a sentence that goes on for a while. And another; the end.").otherwise(F.col("text"))
    heads = order_headers(spark, d).withColumn("name", F.when((m == 2) & (c == 0), "Author").when((m == 2) & (c == 1), "Affiliation").when((m == 2) & (c == 2), "Email").otherwise(F.col("name")))
    return classify.metadata_tables(order_cells(spark, d).withColumn("text", text), heads)


@query("q69_read_backwards", f"""WITH {CELLS_SQL}, b AS (SELECT table_id, count(*) AS n FROM order_cells GROUP BY 1) SELECT table_id, table_id % 3 = 0 AS backwards FROM b""")
def q69(spark, d):
    heads = order_headers(spark, d).withColumn("name", F.when((F.col("table_id") % 3 == 0) & (F.col("col_idx") < 2), F.when(F.col("col_idx") == 0, "elpmaS").otherwise("mpp_hT")).otherwise(F.col("name")))
    return classify.read_backwards(order_cells(spark, d), heads)


@query("q70_upside_down", f"""WITH {ROWS_SQL}, t AS (SELECT table_id, max(row_idx) AS last FROM order_rows GROUP BY 1) SELECT table_id, last >= 1 AND table_id % 4 = 0 AS upside_down FROM t""")
def q70(spark, d):
    turned = F.col("table_id") % 4 == 0
    last = order_rows(spark, d).groupBy("table_id").agg(F.max("row_idx").alias("last"))
    cells = order_cells(spark, d).join(last, "table_id").withColumn("text", F.when(turned & (F.col("row_idx") == F.col("last")), F.concat(F.lit("Name "), F.col("col_idx").cast("string"), F.lit("x"))).otherwise(F.col("text"))).drop("last")
    heads = order_headers(spark, d).withColumn("name", F.when(turned, (F.col("col_idx") * 10 + 3).cast("string")).otherwise(F.col("name")))
    return classify.upside_down(cells, heads)


@query("q71_document_class", """WITH p AS (SELECT o_custkey AS doc_id, o_orderkey % 60 AS page_idx, (o_orderkey % 50)::BIGINT AS chars, (o_orderkey % 160)::DOUBLE AS x_spread FROM orders), a AS (SELECT doc_id, count(*) AS n_pages, coalesce(sum(chars) FILTER (page_idx < 5), 0)::BIGINT AS chars, max(x_spread) AS s FROM p GROUP BY 1)
SELECT doc_id, n_pages, chars, CASE WHEN chars < 100 THEN 'scanned' WHEN n_pages >= 40 THEN 'thesis' WHEN s > 150 THEN 'double_column' ELSE 'single_column' END AS doc_class FROM a""")
def q71(spark, d):
    k = F.col("o_orderkey")
    pages = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 60).alias("page_idx"), (k % 50).alias("chars"), (k % 160).cast("double").alias("x_spread"))
    return classify.document_class(pages)


@query("q72_token_containment", f"""WITH a AS (SELECT DISTINCT l_orderkey AS pair_id, 'P' || l_partkey AS token FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS pair_id, CASE WHEN l_suppkey % 3 = 0 THEN 'P' || l_partkey WHEN l_suppkey % 3 = 1 THEN 'xP' || l_partkey ELSE 'none' END AS token FROM lineitem),
h AS (SELECT a.pair_id, a.token, bool_or(a.token = b.token OR (length(a.token) >= 3 AND contains(b.token, a.token)) OR (length(b.token) >= 3 AND contains(a.token, b.token))) AS hit FROM a JOIN b USING (pair_id) GROUP BY 1, 2)
SELECT pair_id, count(*) AS n, round(count(*) FILTER (hit) / count(*), 6) AS containment FROM h GROUP BY 1""")
def q72(spark, d):
    li, m, p = read(spark, d, "lineitem"), F.col("l_suppkey") % 3, F.concat(F.lit("P"), F.col("l_partkey"))
    a = li.select(F.col("l_orderkey").alias("pair_id"), p.alias("token"))
    b = li.select(F.col("l_orderkey").alias("pair_id"), F.when(m == 0, p).when(m == 1, F.concat(F.lit("x"), p)).otherwise("none").alias("token"))
    return classify.token_containment(a, b).withColumn("containment", F.round("containment", 6))


@query("q73_truth_scores", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 2 = 0 AS lm, l_partkey % 3 = 0 AS pm, l_suppkey % 4 AS shared, (l_suppkey % 10) / 10.0 AS r, (l_partkey % 7)::BIGINT AS cols FROM lineitem),
s AS (SELECT *, CASE WHEN lm THEN 0.4 ELSE 0 END + CASE WHEN pm THEN 0.2 ELSE 0.1 END + CASE WHEN cols > 0 THEN 0.2 * least(cols, 5) / greatest(cols, 5) ELSE 0 END + 0.4 * least(1.0, r) AS raw FROM p)
SELECT shared, cols, lm, pm, round(max(CASE WHEN lm OR shared >= 3 OR r >= 0.2 THEN raw ELSE least(raw, 0.3) END), 6)::DOUBLE AS best, count(*) AS n FROM s GROUP BY 1, 2, 3, 4""")
def q73(spark, d):
    r = (F.col("l_suppkey") % 10).cast("double") / 10
    p = read(spark, d, "lineitem").select((F.col("l_partkey") % 2 == 0).alias("label_match"), (F.col("l_partkey") % 3 == 0).alias("page_match"), F.lit(True).alias("later_page"), (F.col("l_partkey") % 7).alias("cols"), F.lit(5).alias("truth_cols"), (F.col("l_suppkey") % 4).alias("shared"), r.alias("recall"), r.alias("jaccard"), F.lit(False).alias("cross_validated"))
    out = classify.truth_scores(p)
    return out.groupBy("shared", "cols", F.col("label_match").alias("lm"), F.col("page_match").alias("pm")).agg(F.round(F.max("score"), 6).alias("best"), F.count(F.lit(1)).alias("n"))


@query("q74_split_rows", f"""WITH {ROWS_SQL} SELECT table_id || ':' || row_idx AS pair_id, l_partkey % 3 = 0 AS merged,
  'S' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '|long text and more|7' ELSE '|1.5|' END AS row FROM order_rows""")
def q74(spark, d):
    rows = order_rows(spark, d, "l_partkey").withColumn("table_id", F.concat_ws(":", "table_id", "row_idx"))
    m = F.col("l_partkey") % 3
    last = F.array(F.concat(F.lit("S"), F.col("l_partkey")), F.when(m == 0, "long text and").otherwise("1.5"), F.lit(""))
    first = F.array(F.when(m == 2, "T").otherwise(""), F.when(m == 0, "more").otherwise("2.5"), F.lit("7"))
    return classify.join_split_rows(rows.select(F.col("table_id").alias("pair_id"), last.alias("last"), first.alias("first"))).select("pair_id", "merged", F.array_join("row", "|").alias("row"))


@query("q75_script_runs", """WITH r AS (SELECT unnest([struct_pack(align := NULL, chunk := 'H'), struct_pack(align := 'subscript', chunk := '2'), struct_pack(align := NULL, chunk := 'O 10'),
  struct_pack(align := 'superscript', chunk := '-' || p_size), struct_pack(align := NULL, chunk := ' p_brand_' || p_size)]) AS r FROM part) SELECT r.align AS align, r.chunk AS chunk, count(*) AS n FROM r GROUP BY 1, 2""")
def q75(spark, d):
    p = read(spark, d, "part")
    text = F.concat(F.lit("H_2O 10^{-"), F.col("p_size"), F.lit("} p_brand_"), F.col("p_size"))
    runs = p.select("p_partkey", F.explode(classify.script_runs(text)).alias("r"))
    return runs.groupBy(F.col("r.align").alias("align"), F.col("r.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("q76_clean_tables")
def q76(spark, d):
    i, c = F.col("row_idx"), F.col("col_idx")
    text = F.when((i % 5 == 4) & (c == 0), "(continued)").when(i % 5 == 4, "").otherwise(F.col("text"))
    return cleaning.clean_tables(order_cells(spark, d).withColumn("text", text), order_headers(spark, d))["cells"]


@query("q77_candidate_pages", """WITH s AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 40)::INT AS page_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'caption' ELSE 'grid' END AS signal FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 40)::INT AS page_idx FROM orders WHERE o_orderkey % 3 <> 0),
dd AS (SELECT doc_id, page_idx, string_agg(signal, ',' ORDER BY signal) AS signals FROM s GROUP BY 1, 2), r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.doc_id = c.doc_id AND dd.page_idx = c.page_idx)),
i AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS k FROM r), g AS (SELECT doc_id, k, min(page_idx) AS a, max(page_idx) AS b FROM i GROUP BY 1, 2), l AS (SELECT g.* FROM g JOIN dd ON dd.doc_id = g.doc_id AND dd.page_idx + 1 = g.a)
SELECT doc_id, page_idx, signals FROM dd UNION ALL SELECT doc_id, unnest(generate_series(a, least(b, a + 9)))::INT, 'continued' FROM l""")
def q77(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 40).cast("int").alias("page_idx"), "o_orderkey")
    signals = o.where("o_orderkey % 3 = 0").select("doc_id", "page_idx", F.when(F.col("o_orderkey") % 2 == 0, "caption").otherwise("grid").alias("signal"))
    out = cleaning.candidate_pages(signals, o.where("o_orderkey % 3 <> 0").select("doc_id", "page_idx"))
    return out.withColumn("signals", F.array_join("signals", ","))


@query("q78_reconcile_sources")
def q78(spark, d):
    p = read(spark, d, "part")
    x, y = (F.col("p_partkey") * 37 % 500).cast("double"), (F.col("p_size") * 14).cast("double")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Table "), F.col("p_partkey"))).otherwise("")
    native = p.select((F.col("p_partkey") % 100).alias("doc_id"), (F.col("p_partkey") % 7).alias("page_idx"), F.col("p_partkey").alias("box_id"), label.alias("label"), x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 60).alias("y1"))
    other = native.where("box_id % 4 <> 1").withColumns({"x0": F.col("x0") + 9, "x1": F.col("x1") + 9, "page_idx": F.when(F.col("box_id") % 5 == 0, 99).otherwise(F.col("page_idx"))})
    shared = native.where("box_id % 10 < 8").select(F.col("box_id").alias("native_id"), F.col("box_id").alias("other_id"), F.lit(0.8).alias("share"))
    return cleaning.reconcile(native, other, shared)


@query("q79_block_ratio")
def q79(spark, d):
    p = read(spark, d, "part")
    return scored_pairs(p, "p_partkey", "p_name", ["p_brand", "p_type", "p_size"], block_ratio)
