from pyspark.sql import functions as F

from gridlode.operators import classify as c

CELL = "table_id long, row_idx int, col_idx int, text string"


def cells_of(spark, tables):
    return spark.createDataFrame([(i, r, k, v) for i, rows in enumerate(tables) for r, row in enumerate(rows) for k, v in enumerate(row)], CELL)


def heads_of(spark, heads):
    return spark.createDataFrame([(i, k, v) for i, row in enumerate(heads) for k, v in enumerate(row)], "table_id long, col_idx int, name string")


def test_metadata_and_data(spark):
    tables = [
        [["A", "1.2"], ["B", "3.4"], ["C", "5"]], [["Ann", "Uni"]], [["x", "1"]], [["[1] Smith 2001 et al.", "a"], ["[2] Lee 2003", "b"], ["[3] Fox", "c"], ["[4] Ray", "d"]],
        [["The first sentence is long enough here. And more.", "Another sentence that is long enough; it goes on."]] * 3, [["only"]], [["收稿日期 2020", ""]],
    ]
    heads = [["Sample", "Value"], ["Author", "Affiliation"], ["Title", "DOI"], ["a", "b"], ["a", "b"], ["a"], ["a", "b"]]
    heads[1].append("Email")
    tables[1][0].append("a@b")
    got = {r.table_id: r.reason for r in c.metadata_tables(cells_of(spark, tables), heads_of(spark, heads)).collect()}
    assert got == {0: "data", 1: "authors", 2: "data", 3: "references", 4: "prose", 5: "single_cell", 6: "front_matter"}


def test_turned_tables(spark):
    tables = [[["elpmaS", "muitrof"], ["1", "2"]], [["Sample", "x"], ["1", "2"]], [["1", "2"], ["Name", "Age"]]]
    heads = [["Unnamed: 0", "b"], ["a", "b"], ["33", "44"]]
    cells, headers = cells_of(spark, tables), heads_of(spark, heads)
    assert {r.table_id: r.backwards for r in c.read_backwards(cells, headers).collect()} == {0: True, 1: False, 2: False}
    assert {r.table_id: r.upside_down for r in c.upside_down(cells, headers).collect()} == {0: False, 1: False, 2: True}


def test_small_flags(spark):
    cells = cells_of(spark, [[["a\nb", "c\nd"]], [["1", "2"], ["3", "4"], ["...", ""]], [["x" * 90]]])
    assert {r.table_id: r.merged for r in c.merged_rows(cells).collect()} == {0: True, 1: False, 2: False}
    assert {r.table_id: r.truncated for r in c.truncated_online(cells).collect()} == {0: True, 1: True, 2: True}
    labels = spark.createDataFrame([(2, "")], "table_id long, label string")
    assert {r.table_id: r.shell for r in c.layout_shell(cells, labels).collect()} == {0: False, 1: False, 2: True}
    pages = spark.createDataFrame([(1, 0, 10, 0.0), (2, 0, 5000, 200.0), *[(3, i, 900, 0.0) for i in range(40)]], "doc_id long, page_idx int, chars int, x_spread double")
    assert {r.doc_id: r.doc_class for r in c.document_class(pages).collect()} == {1: "scanned", 2: "double_column", 3: "thesis"}


def test_wrapped_references(spark):
    lines = spark.createDataFrame([(1, 0, "The values are shown in"), (1, 1, "Table 3"), (2, 0, "End."), (2, 1, "Table 1. A proper title of it")], "doc_id long, line_no int, line string")
    assert [(r.doc_id, r.wrapped) for r in c.wrapped_references(lines).where("line like 'Table%'").orderBy("doc_id").collect()] == [(1, True), (2, False)]


def test_containment_and_truth(spark):
    a = spark.createDataFrame([(1, "sample"), (1, "12.5"), (1, "zz")], "pair_id long, token string")
    b = spark.createDataFrame([(1, "samples"), (1, "12.5")], "pair_id long, token string")
    (r,) = c.token_containment(a, b).collect()
    assert (r.n, round(r.containment, 6)) == (3, round(2 / 3, 6))
    p = spark.createDataFrame([(True, True, False, 5, 5, 10, 1.0, 1.0, False), (False, True, False, 5, 5, 1, 0.1, 0.1, False)], "label_match boolean, page_match boolean, later_page boolean, cols int, truth_cols int, shared int, recall double, jaccard double, cross_validated boolean")
    assert [round(r.score, 6) for r in c.truth_scores(p).collect()] == [1.2, 0.3]


def test_rows_over_a_page_break(spark):
    rows = [(1, ["A", "long text and", "1"], ["", "more", ""]), (2, ["A", "1.5", "x"], ["", "2.5", ""]), (3, ["A", "1", ""], ["B", "2", ""]), (4, ["frag-", "", ""], ["ment", "", "5"]), (5, ["A", "", "1"], ["", "7", ""])]
    got = {r.pair_id: (r.merged, r.row) for r in c.join_split_rows(spark.createDataFrame(rows, "pair_id long, last array<string>, first array<string>")).collect()}
    assert got == {1: (True, ["A", "long text and more", "1"]), 2: (False, ["A", "1.5", "x"]), 3: (False, ["A", "1", ""]), 4: (True, ["fragment", "", "5"]), 5: (True, ["A", "7", "1"])}


def test_script_runs(spark):
    rows = [("H_2O", [("H", None), ("2", "subscript"), ("O", None)]), ("10^{-3}", [("10", None), ("-3", "superscript")]), ("table_1", [("table_1", None)]), ("Fe³⁺", [("Fe", None), ("3+", "superscript")]), ("CaCO₃", [("CaCO", None), ("3", "subscript")]), ("", [])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", c.script_runs(F.col("t")).alias("r"))
    assert {r.t: [(x.chunk, x.align) for x in r.r] for r in df.collect()} == dict(rows)


def test_plans(spark):
    df = spark.createDataFrame([(1, "A study (2015)", "https://x.wiley.com/a", 5000), (2, None, None, None)], "doc_id long, title string, url string, chars int")
    assert [(r.year, r.publisher, r.scanned, r.online_viable) for r in c.plan_documents(df).orderBy("doc_id").collect()] == [(2015, "wiley", False, True), (None, "none", True, False)]
