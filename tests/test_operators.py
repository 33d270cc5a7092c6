import pytest
from pyspark.sql import functions as F

from gridlode.operators import align, arbitrate, audit, boxes, catalog, geometry, ledger, merge, profile, shape, similarity

CELL = "table_id long, row_idx int, col_idx int, text string"


def cells_of(spark, *tables):
    return spark.createDataFrame([(i, r, c, v) for i, rows in enumerate(tables) for r, row in enumerate(rows) for c, v in enumerate(row)], CELL)


def grid(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.table_id, {}).setdefault(r.row_idx, {})[r.col_idx] = r.text
    return {t: [[rows[i][c] for c in sorted(rows[i])] for i in sorted(rows)] for t, rows in out.items()}


def test_notes_are_told_from_data(spark):
    table = [["Sample A", "12.5", "3.2"], ["* p < 0.05 compared with the others", "", ""], ["Note: all values", None, ""], ["注：数据", "", ""], ["1", "Granite", ""]]
    got = {r.row_idx: r.is_note for r in profile.footnote_rows(cells_of(spark, table)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False}


def test_paywalls_leave_science_alone(spark):
    got = {r.table_id: r.paywall for r in profile.paywall_tables(cells_of(spark, [["parent rock", "different"]], [["Institutional login"]], [["Login", "subscribe"]], [["rent"]], [["accept cookies"]] * 5)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_first_rows_over_values(spark):
    got = {r.table_id: r.promote for r in profile.promotable_first_rows(cells_of(spark, [["Sample", "Conc"], ["A", "1"], ["B", "2"]], [["A01", "13"], ["A02", "14"]], [["x", "2020"], ["a", "5"], ["b", "6"]], [["Sample", "1"]], [["Col_1", "b"], ["1", "2"]])).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}


def test_squeezed_columns_are_cut(spark):
    got = grid(shape.expand_squeezed(cells_of(spark, [["a", "1 2"], ["b", "3 4"], ["c", "5 6"], ["d", "7 8 9"], ["e", ""]])))
    assert got[0] == [["a", "1", "2"], ["b", "3", "4"], ["c", "5", "6"], ["d", "7", "8 9"], ["e", "", ""]]


def test_lines_become_rows(spark):
    assert grid(shape.expand_multiline(cells_of(spark, [["g", "1\n2"], ["h", "3"]])))[0] == [["g", "1"], ["g", "2"], ["h", "3"]]


def test_headers_are_flattened(spark):
    rows = [(0, lv, c, v) for lv, row in enumerate([["Sample", "", "Major", "", "Total"], ["Id", "Spot", "SiO2", "FeO", "total"]]) for c, v in enumerate(row)]
    df = spark.createDataFrame(rows, "table_id long, level int, col_idx int, text string")
    assert [r.name for r in shape.flatten_headers(df).orderBy("col_idx").collect()] == ["Sample > Id", "Sample > Spot", "Major > SiO2", "Major > FeO", "Total"]


def test_footers_are_a_suffix_and_leave_a_row(spark):
    table = [["a", "1", "x"], ["Note: early remark", "", ""], ["b", "2", "y"], ["Note: the values", "", ""], ["* p < 0.05 in all of them", "", ""]]
    got = {r.row_idx: r.in_footer for r in shape.split_footnotes(cells_of(spark, table)).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True}


def test_spans_and_empty_columns(spark):
    df = spark.createDataFrame([(0, 0, 0, "A", 2, 2), (0, 0, 2, "B", 1, 1)], CELL + ", row_span int, col_span int")
    assert sorted((r.row_idx, r.col_idx, r.text) for r in shape.spread_spans(df).collect()) == [(0, 0, "A"), (0, 1, "A"), (0, 2, "B"), (1, 0, "A"), (1, 1, "A")]
    assert grid(shape.drop_empty_columns(cells_of(spark, [["a", "", "1"], ["b", None, "2"]])))[0] == [["a", "1"], ["b", "2"]]


def test_complementary_merge(spark):
    a = spark.createDataFrame([(1, "13", "A"), (1, "25", "B"), (1, "31", "C"), (2, "1", "A")], "pair_id long, si string, sample string")
    b = spark.createDataFrame([(1, "25.0", "8"), (1, "13.0", "7"), (2, "9", "5")], "pair_id long, si string, ca string")
    got = sorted((r.pair_id, r.si, r.sample, r.ca) for r in merge.complementary(a, b, "si", ["ca"]).collect())
    assert got == [(1, "13", "A", "7"), (1, "25", "B", "8"), (1, "31", "C", ""), (2, "1", "A", "")]


def test_versions_that_differ(spark):
    schema = "pair_id long, sample string, field string, value string"
    a = spark.createDataFrame([(1, "A", "x", "1"), (1, "B", "x", "2"), (2, "A", "x", "1"), (3, "A", "x", "1"), (3, "B", "x", "2")], schema)
    b = spark.createDataFrame([(1, "A", "x", "2"), (1, "B", "x", "1"), (2, "Z", "x", "1"), (3, "A", "x", "1"), (3, "B", "x", "2")], schema)
    got = {r.pair_id: (r.swaps, r.distinct_version) for r in merge.conflict(a, b).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, False)}


def test_groups_and_ranges_of_pages(spark):
    f = spark.createDataFrame(
        [(1, 0, 0, "Table 1", ["A", "B"], False), (1, 1, 1, "Table 1", ["A", "B"], False), (1, 2, 2, "", ["a", "b"], False), (1, 3, 3, "Table 2", ["A"], False), (1, 4, 9, "Table 2", ["A"], False)],
        "doc_id long, seq int, page_idx int, label string, columns array<string>, is_continuation boolean",
    )
    assert [r.group_no for r in align.continuation_groups(f).orderBy("seq").collect()] == [1, 1, 1, 2, 3]
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 4)], "doc_id long, page_idx int")
    assert [r.ranges for r in align.format_page_ranges(pages).collect()] == ["1-3,5"]


def test_monotone_match_keeps_order():
    assert align.monotone_match([[0.9, 0.1, 0.0], [0.1, 0.1, 0.8]]) == [(0, 0), (1, 2)]
    assert align.monotone_match([[0.0, 0.9], [0.9, 0.0]]) in ([(0, 1)], [(1, 0)])
    assert align.monotone_match([]) == []


def test_tree_similarity_vectors():
    a = similarity.tree_of(["S", "V"], [["A", "8.4"], ["B", "2"]])
    b = similarity.tree_of(["S", "V"], [["A", "9.9"], ["B", "2"]])
    other = similarity.tree_of(["x", "y", "z"], [["q", "w", "e"]] * 4)
    assert similarity.tree_similarity(a, a) == 1.0
    assert 0.85 < similarity.tree_similarity(a, b) < 1.0
    assert similarity.tree_similarity(a, b, structure_only=True) == 1.0
    assert similarity.tree_similarity(a, other) < 0.6
    assert similarity.tree_similarity(a, b) == pytest.approx(similarity.tree_similarity(b, a))
    empty = similarity.tree_of(None, [])
    assert similarity.tree_similarity(empty, empty) == 1.0 and similarity.tree_similarity(empty, a) == 0.0


def test_votes(spark):
    c = spark.createDataFrame([(1, 10, 0, 3), (1, 11, 1, 3), (1, 12, 2, 3), (2, 20, 0, 3), (2, 21, 1, 6)], "doc long, id long, priority int, n_rows int")
    p = spark.createDataFrame([(1, 10, 11, 0, 1, 0.2), (1, 11, 12, 1, 2, 0.9), (2, 20, 21, 0, 1, 0.3)], "doc long, a_id long, b_id long, a_priority int, b_priority int, similarity double")
    assert {r.doc: (r.winner, r.low_confidence, r.n_rows_differ) for r in arbitrate.vote(c, p, ["doc"]).collect()} == {1: (11, False, False), 2: (20, True, True)}


def test_gate_never_loses_rows(spark):
    schema = "table_id long, n_rows int, n_cols int, n_filled int, low_quality boolean, samples array<string>"
    n = spark.createDataFrame([(1, 10, 4, 40, False, ["a"]), (2, 0, 0, 0, False, []), (3, 3, 3, 9, True, ["a", "b"])], schema)
    o = spark.createDataFrame([(1, 7, 4, 28, False, ["a"]), (2, 3, 3, 9, False, ["a"]), (3, 3, 3, 9, False, ["a", "b"])], schema)
    assert {r.table_id: r.replace for r in arbitrate.replacement_gate(n, o).collect()} == {1: False, 2: True, 3: True}


def test_boxes(spark):
    schema = "page int, box_id long, x0 double, y0 double, x1 double, y1 double, score double, kind int"
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, 2, 1.0, 1.0, 11.0, 11.0, 0.8, 0), (0, 3, 50.0, 50.0, 60.0, 60.0, 0.7, 0)], schema)
    assert sorted(r.box_id for r in boxes.suppress(a, ["page"]).collect()) == [1, 3]
    pairs = {(r.a_id, r.b_id): r.iou for r in boxes.overlap_pairs(a, a, ["page"]).collect()}
    assert pairs[1, 1] == 1.0 and pairs[1, 2] == pytest.approx(81 / 119) and (1, 3) not in pairs
    hits = boxes.greedy_hits(a, a.where("box_id <> 3"), ["page"], [0.5, 0.99]).collect()
    assert sorted((r.threshold, r.box_id, r.tp) for r in hits) == [(0.5, 1, 1), (0.5, 2, 1), (0.5, 3, 0), (0.99, 1, 1), (0.99, 2, 1), (0.99, 3, 0)]


def test_average_precision(spark):
    hits = spark.createDataFrame([("p", 1, 1), ("p", 2, 0), ("p", 3, 1)], "page string, rank int, tp int")
    (r,) = boxes.average_precision(hits, spark.createDataFrame([("p", 2)], "page string, n_truth int"), ["page"]).collect()
    assert r.ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6) and r.recall == 1.0


def test_words_become_a_grid():
    words = [(10, 0, 20, "Id"), (60, 1, 80, "Size"), (85, 1, 95, "cm"), (10, 20, 20, "1"), (62, 21, 80, "5")]
    assert geometry.grid_of(words) == [(0, 0, "Id"), (0, 1, "Size"), (0, 2, "cm"), (1, 0, "1"), (1, 1, "5")]


def test_ledger(spark):
    d = spark.createDataFrame([(1, "Table 1"), (1, "Table 2"), (2, "Table 1")], "doc_id long, label string")
    e = spark.createDataFrame([(1, "Table 1"), (3, "Table 9")], "doc_id long, label string")
    assert sorted((r.doc_id, r.label) for r in ledger.missing_tables(d, e).collect()) == [(1, "Table 2"), (2, "Table 1")]
    assert {r.doc_id: r.recall for r in ledger.completeness(d, e).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    cap = spark.createDataFrame([(1, 0, 3, "Table 1")], "doc_id long, page_idx int, line_no int, label string")
    tables = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 9, 0)], "doc_id long, page_idx int, table_idx int")
    assert [(r.label, r.is_continuation) for r in ledger.captions_by_ordinal(tables, cap).orderBy("page_idx").collect()] == [("Table 1", False), ("Table 1", True), (None, False)]


def test_audit_and_catalog(spark):
    docs = spark.createDataFrame([(0, True, 0), (1, False, 0), (9, False, 9)], "missing int, has_manifest boolean, anomalies int")
    assert [(r.score, r.band) for r in audit.document_scores(docs).collect()] == [(100, "pass"), (75, "low"), (20, "low")]
    gaps = audit.numbering_gaps(spark.createDataFrame([(1, "", 1), (1, "", 2), (1, "", 5)], "doc_id long, chapter string, number int"))
    assert [r.missing_number for r in gaps.collect()] == [3, 4]
    df = spark.createDataFrame([("storage:a.pdf", "K1"), ("attachments:b.pdf", "K2"), ("file:///c.pdf", "K3"), ("/d.pdf", "K4")], "raw string, key string")
    assert [r.p for r in df.select(catalog.attachment_path(F.col("raw"), F.col("key"), "/s/", "/b").alias("p")).collect()] == ["/s/K1/a.pdf", "/b/b.pdf", "/c.pdf", "/d.pdf"]
