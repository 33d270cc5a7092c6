"""Queries on cells of orders: many tables together, and no cell dealt twice."""

import random
from pathlib import Path

from gridlode.operators import audit, classify, evaluate, profile, shape, similarity
from gridlode.plans import QUERIES, fixtures
from gridlode.plans.fixtures import order_cells, order_headers, order_rows
from gridlode.session import tasks_of
from gridlode.sources import markdown, sinks


def lines(spark, tmp_path: Path) -> str:
    rows = [(k, n, k * 7 + n, k + n, 10.5 + n, float(n + 1), 0.0, 0.0, "A", "O") for k in range(30) for n in range(k % 6 + 1)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).selectExpr("*", "date'2024-01-01' as l_shipdate").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tree_scores_of_one_form_are_computed_together(monkeypatch):
    r = random.Random(3)
    text = lambda: r.choice(["", "a", "12.50", f"S-{r.randrange(900)}", "x" * 70 + str(r.randrange(9)), f"±é中{r.randrange(99)}", " t ", None])
    forms = [(r.randrange(4), r.randrange(4), r.randrange(4), r.randrange(3)) for _ in range(40)]
    table = lambda rows, cols: [[text() for _ in range(cols)] for _ in range(rows)]
    tables = [(table(1, f)[0], table(n, f), table(1, g)[0], table(m, g)) for n, m, f, g in forms for _ in range(6)]
    want = [similarity.tree_similarity(similarity.tree_of(a, b), similarity.tree_of(c, d)) for a, b, c, d in tables]
    assert similarity._tree_scores_of(tables) == want
    monkeypatch.setattr(similarity, "tree_distance", None)  # no pair goes alone
    pairs = [(["h"], [["a", str(k)]], ["h"], [["b", str(k + 1)]]) for k in range(20)]
    assert len(similarity._tree_scores_of(pairs)) == 20


def test_lines_of_orders_are_dealt_over_all_tasks(spark, tmp_path):
    rows = order_rows(spark, lines(spark, tmp_path))
    plan = plan_of(rows)
    assert plan.index("Window") < plan.index("RepartitionByExpression")
    assert rows.count() == sum(k % 6 + 1 for k in range(30))


def test_noise_rows_meet_the_names_of_their_table(spark, tmp_path):
    d = lines(spark, tmp_path)
    noise = shape.noise_rows(order_cells(spark, d), order_headers(spark, d))
    assert "word#" not in plan_of(noise).split("Join", 1)[1].split("\n")[0]  # joined by table alone
    cells = spark.createDataFrame([(1, 0, 0, "x"), (1, 1, 0, "Price"), (1, 1, 1, "(USD)"), (1, 2, 0, "")], "table_id long, row_idx int, col_idx int, text string")
    heads = spark.createDataFrame([(1, 0, "Price (USD)"), (1, 1, "(USD)")], "table_id long, col_idx int, name string")
    assert {r.row_idx: r.noise for r in shape.noise_rows(cells, heads).collect()} == {0: None, 1: "repeated_header", 2: "empty"}


def test_columns_are_found_in_the_array_of_their_table(spark):
    truth = spark.createDataFrame([(t, i, n) for t in range(9) for i, n in enumerate(["A b", "x_Spot", "q", "z"])], "table_id long, col_idx int, name string")
    found = spark.createDataFrame([(t, i, n) for t in range(9) for i, n in enumerate(["y_spot", "ab", "AB"])], "table_id long, col_idx int, name string")
    out = evaluate.column_map(truth, found)
    assert plan_of(out).count("Join") == 1 and "RepartitionByExpression" in plan_of(out)
    assert {(r.want_idx, r.got_idx, r.how) for r in out.collect()} == {(0, 1, "name"), (1, 0, "leaf"), (2, 2, "place"), (3, None, "none")} and out.count() == 36


def test_tokens_are_distinct_before_they_are_dealt(spark, tmp_path):
    plan = plan_of(evaluate.table_tokens(order_cells(spark, lines(spark, tmp_path)), order_headers(spark, str(tmp_path))))
    assert "RepartitionByExpression" in plan.split("Union")[0] and plan.split("Union", 1)[1].count("Aggregate [table_id") >= 2


def test_lines_of_markdown_are_sorted_and_never_joined(spark):
    text = "Table 1. A\n| a | b |\n|---|---|\n| 1 | 2 |\nTable 2. B\nTable 3. C\n| c |\n\n| d | e |"
    out = markdown.scan_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert "Join" not in plan_of(out)
    assert {(r.table_no, r.label, r.row_idx, r.col_idx, r.text) for r in out.collect()} == {(1, "Table 1", 0, 0, "a"), (1, "Table 1", 0, 1, "b"), (1, "Table 1", 1, 0, "1"), (1, "Table 1", 1, 1, "2"), (2, "Table 3", 0, 0, "c"), (3, "", 0, 0, "d"), (3, "", 0, 1, "e")}


def test_weak_words_are_one_number(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Outline of orcid"), (1, 0, 1, "an e-mail"), (2, 0, 0, "outlines orcids"), (2, 0, 1, "emails")], "table_id long, row_idx int, col_idx int, text string")
    heads = spark.createDataFrame([(t, c, "v") for t in (1, 2) for c in (0, 1)], "table_id long, col_idx int, name string")
    out = classify.metadata_tables(cells, heads)
    assert {r.table_id: r.reason for r in out.collect()} == {1: "front_matter", 2: "data"}
    assert "bit_or" in plan_of(out)


def test_numbers_and_years_are_judged_once_a_cell(spark):
    cells = spark.createDataFrame([(1, 0, 0, "2019/20"), (1, 1, 0, "5.5"), (1, 2, 0, "n. d."), (2, 0, 0, "1"), (2, 1, 0, "2")], "table_id long, row_idx int, col_idx int, text string")
    out = profile.promotable_first_rows(cells)
    assert {r.table_id: r.promote for r in out.collect()} == {1: True, 2: False}
    assert " AS year#" in plan_of(out)  # a column below the counts


def test_both_sides_of_a_cell_are_grouped_and_not_joined(spark):
    schema = "doc_id long, row_idx int, col_idx int, num double"
    truth = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 0, 20.0), (1, 1, 0, 5.0), (1, 2, 0, None), (2, None, 0, 7.0)], schema)
    found = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 0, 30.0), (1, 2, 0, None), (2, None, 0, 7.0), (3, 0, 0, 1.0)], schema)
    out = audit.confusion(truth, found)
    assert {tuple(r) for r in out.collect()} == {(1, 6, 5, 2, 0.833333), (2, 1, 1, 1, 1.0)}
    assert "Join" not in plan_of(out)


def test_documents_that_are_dealt_are_scored_in_their_task(spark, tmp_path):
    out = QUERIES["q52_ground_truth_eval"](spark, lines(spark, tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("REPARTITION_BY_NUM")  # the lines of each side, and no more
    assert out.count() == 30


def test_large_tables_of_lines_have_more_tasks(spark, tmp_path, monkeypatch):
    d = lines(spark, tmp_path)
    small = order_rows(spark, d)
    assert small.rdd.getNumPartitions() == 4
    monkeypatch.setattr(fixtures, "tasks_of", lambda df: tasks_of(df, 100))
    assert order_rows(spark, d).rdd.getNumPartitions() > 4
    assert sorted(map(tuple, order_rows(spark, d).collect())) == sorted(map(tuple, small.collect()))


def test_split_rows_are_judged_once_a_pair(spark, tmp_path):
    out = QUERIES["q74_split_rows"](spark, lines(spark, tmp_path))
    plan = plan_of(out)
    assert plan.count("exists(z#") == 2  # not once for the verdict and once for the row
    assert "l_tax" not in plan.split("Relation")[0]  # only what orders and makes the rows is dealt
    assert "(?=[A-Z])" not in plan  # a text of a value's form is not tried as a formula too
    assert {r.pair_id.split(":")[0]: (r.merged, r.row) for r in out.where("pair_id like '%:0'").collect()}["3"] == (True, "S21|long text and more|7")


def test_cells_of_a_card_are_grouped_once(spark):
    cells = spark.createDataFrame([(1, 3, 0, "<a>"), (1, 0, 1, None), (1, 0, 0, "b"), (1, 15, 0, "late"), (2, 1, 2, "c"), (2, 1, 0, "d"), (2, 2, 1, "e")], "table_id long, row_idx int, col_idx int, text string")
    out = sinks.preview_cards(cells)
    assert {r.table_id: r.html for r in out.collect()} == {1: "<table><tr><td>b</td><td></td></tr><tr><td>&lt;a&gt;</td></tr></table>", 2: "<table><tr><td>d</td><td>c</td></tr><tr><td>e</td></tr></table>"}
    assert plan_of(out).count("Aggregate [") == 1
