"""Versions of tables: scores without a row for each offset, clusters without a frame for each page."""

from gridlode.operators import arbitrate, similarity

CELL = "id long, row_idx int, col_idx int, text string"
TABLES = {1: [["a", "1"], ["b", "2"], ["c", "3"]], 2: [["x", "y"], ["A ", "12"], ["b", "2"], ["c", ""]], 3: [["", None]]}


def _cells(spark):
    return spark.createDataFrame([(i, r, c, v) for i, rows in TABLES.items() for r, row in enumerate(rows) for c, v in enumerate(row)], CELL)


def _plain(a, b):
    get = lambda t: {(r, c): (v or "").strip(" ").lower() for r, row in enumerate(t) for c, v in enumerate(row)}
    x, y, top = get(a), get(b), None
    for o in similarity.OFFSETS:
        met = [(v, y[r + o, c]) for (r, c), v in x.items() if r < min(len(a), len(b)) and (r + o, c) in y]
        if met:
            s = sum(0.0 if not p and not q else 1.0 if p == q else 0.5 if p and q and (p in q or q in p) else 0.0 for p, q in met) / len(met)
            if s >= similarity.ENOUGH:
                return s
            top = max(s, top or 0.0)
    return top or 0.0


def test_content_is_scored_in_one_shuffle_a_side(spark):
    ids = list(TABLES)
    pairs = spark.createDataFrame([(i * 10 + j, i, j) for i in ids for j in ids], "pair_id long, a_id long, b_id long")
    out = similarity.content_similarity(pairs, _cells(spark), _cells(spark))
    assert {r.pair_id: round(r.content, 9) for r in out.collect()} == {i * 10 + j: round(_plain(TABLES[i], TABLES[j]), 9) for i in ids for j in ids}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Generate" not in plan


def test_clusters_are_made_in_batches(spark):
    cand = [(d, 0, d * 10 + k, k % 2, "", False) for d in range(50) for k in range(4)]
    pairs = [(d, 0, d * 10, d * 10 + 1, 0.9, 0.0, 0.0) for d in range(0, 50, 2)]
    out = arbitrate.cluster_versions(spark.createDataFrame(cand, "doc_id long, page_idx int, id long, priority int, label string, boxed boolean"), spark.createDataFrame(pairs, "doc_id long, page_idx int, a_id long, b_id long, similarity double, iou double, iom double"))
    got = {r.id: r.cluster_no for r in out.collect()}
    assert len(got) == 200 and all((got[d * 10] == got[d * 10 + 1]) == (d % 2 == 0) for d in range(50))
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
