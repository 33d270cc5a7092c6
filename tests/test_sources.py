from pyspark.sql import functions as F

from gridlode.sources import files, markdown, markup, sinks
from gridlode.streaming import ingest


def test_html_spans_scripts_and_bad_markup():
    (t,) = markup.html_tables("<p>x<table><caption>Table 3. X</caption><tr><th rowspan=2>Id<th colspan=2>Size</tr><tr><th>a<th>b</tr><tr><td>1<td>10<sup>2</sup><td>H<sub>2</sub>O &amp; y<br>z</table>")
    assert [[c[0] for c in row] for row in t["grid"]] == [["Id", "Size", "Size"], ["Id", "a", "b"], ["1", "10²", "H₂O & y\nz"]]
    assert (t["label"], t["header_source"]) == ("Table 3", "explicit")
    assert markup.html_tables("<table><tr><td><input><input></td></tr></table>") == [] and markup.html_tables(None) == []
    assert len(markup.html_tables("<table><tr><td>a</td></tr></table>" * 2)) == 1


def test_mixed_text_keeps_its_order(spark):
    text = "Table 1. One\n| a | b |\n|---|---|\n| 1 | 2 |\nmore\nTable 2. Two\n<table><tr><th>x</th></tr><tr><td>9</td></tr></table>\n| lone | y |"
    got = markup.mixed_tables(text)
    assert [(t["label"], [[c[0] for c in r] for r in t["grid"]]) for t in got] == [("Table 1", [["a", "b"], ["1", "2"]]), ("Table 2", [["x"], ["9"]]), ("", [["lone", "y"]])]
    assert markup.scan_mixed(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")).count() == 8


def test_jats_and_cals():
    jats = '<a xmlns="u"><table-wrap><label>Table 1</label><caption><p>Rocks</p></caption><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td rowspan="2">1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table><table-wrap-foot><fn>note</fn></table-wrap-foot></table-wrap></a>'
    (t,) = markup.xml_tables(jats)
    assert [[c[0] for c in r] for r in t["grid"]] == [["A", "B"], ["1", "2"], ["1", "3"]] and t["footnotes"] == ["note"] and t["caption"] == "Table 1 Rocks"
    cals = '<a><table-wrap><table><tgroup><colspec colname="c1"/><colspec colname="c2"/><thead><row><entry namest="c1" nameend="c2">H</entry></row></thead><tbody><row><entry morerows="1">x</entry><entry>1</entry></row><row><entry>2</entry></row></tbody></tgroup></table></table-wrap></a>'
    (t,) = markup.xml_tables(cals)
    assert [[c[0] for c in r] for r in t["grid"]] == [["H", "H"], ["x", "1"], ["x", "2"]]
    assert markup.xml_tables("<broken") == []


def test_markdown(spark):
    text = "<!-- Page 3 -->\nTable 2. Sizes\n| a | b |\n|---|---|\n| 1 |  |\n\ntext\n| lone | x |\n"
    got = markdown.scan_markdown(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("table_no", "row_idx", "col_idx").collect()
    assert [(r.table_no, r.page_idx, r.label, r.row_idx, r.col_idx, r.text) for r in got] == [(1, 2, "Table 2", 0, 0, "a"), (1, 2, "Table 2", 0, 1, "b"), (1, 2, "Table 2", 1, 0, "1"), (1, 2, "Table 2", 1, 1, ""), (2, 2, "", 0, 0, "lone"), (2, 2, "", 0, 1, "x")]
    pages = markdown.split_pages(spark.createDataFrame([(1, "a\n<!-- Page 2 -->\nb")], "doc_id long, text string")).orderBy("page_idx").collect()
    assert [(r.page_idx, r.text) for r in pages] == [(0, "a"), (1, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n007,\n1,x\n")
    assert [tuple(r) for r in files.read_csv_table(spark, str(tmp_path / "t.csv")).collect()] == [("007", ""), ("1", "x")]
    (tmp_path / "list.txt").write_text("# no\n/a.pdf\n\n /b.pdf \n")
    assert [r.path for r in files.read_input_list(spark, str(tmp_path / "list.txt")).collect()] == ["/a.pdf", "/b.pdf"]
    (tmp_path / "m.txt").write_text("Table 1\tRocks\nTable 2\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.txt")).collect()] == [("Table 1", "Rocks"), ("Table 2", "")]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "Table 10", "x", 0, 0), (1, "Table 2", "short", 1, 0), (1, "Table 2", "longer one", 2, 0), (1, "", "", 3, 0)], "doc_id long, label string, title string, page_idx int, table_idx int")
    assert [(r.label, r.title) for r in sinks.manifest(t.where("label <> ''")).orderBy("position").collect()] == [("Table 2", "longer one"), ("Table 10", "x")]
    assert sorted(r.file_name for r in sinks.file_names(t).collect()) == ["Table 1", "Table 10", "Table 2", "Table 2_p3"]
    cells = spark.createDataFrame([(1, 0, 0, "<b>&"), (1, 0, 1, "x")], "table_id long, row_idx int, col_idx int, text string")
    assert [r.html for r in sinks.preview_cards(cells).collect()] == ["<table><tr><td>&lt;b&gt;&amp;</td><td>x</td></tr></table>"]
    sinks.write_tables(spark.createDataFrame([("a", 0, "1"), ("b", 0, "2")], "name string, row_idx int, v string"), str(tmp_path / "out"), ["name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_streaming_drop_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:10:00", "b"), (2, "2024-01-01 00:20:00", "c")], "doc_id long, seen string, text string").withColumn("seen", F.to_timestamp("seen"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.watch(spark, f"{tmp_path}/in", rows.schema, "doc_id", "seen")
    query = ingest.run_stages(stream, [lambda b: b.withColumn("n", F.length("text"))], f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    query.awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()) == [1, 2]
