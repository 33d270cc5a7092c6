from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlode.llm.decontaminate import find_leaks, stage_decontaminate

from corpus_samples import prose


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, prose(1000 + k, 15 + 3 * k)) for k in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, prose(1000, 15))]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items, threshold=0.8):
    def shingles(words, n=5):
        n = min(n, len(words))
        return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))

    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            goal = (item or "").lower().split()
            if not goal or not words:
                continue
            want = shingles(goal)
            for s in range(max(1, len(words) - len(goal) + 1)):
                have = shingles(words[s : s + len(goal)])
                both = sum((have & want).values())
                value = both / (sum(have.values()) + sum(want.values()) - both)
                if value >= threshold - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), round(value, 9))
    return out


def test_planted_items_against_brute_force(make_docs, items):
    given = [tuple(r) for r in items.collect()]
    rows = []
    for k, (i, text) in enumerate(given):
        words = (text or "").split()
        rows.append((10 * k, prose(k, 40) + " " + (text or "") + " " + prose(k + 100, 30)))
        rows.append((10 * k + 1, (text or "").upper()))
        if len(words) > 20:
            changed = words.copy()
            changed[2] = "changed"
            rows.append((10 * k + 2, " ".join(changed)))
            rows.append((10 * k + 3, " ".join(words[: len(words) // 2])))
            rows.append((10 * k + 4, prose(k, 9) + " " + " ".join(words[:10] + ["more"] + words[10:]) + " end"))
    rows += [(900 + k, prose(3000 + k, 200)) for k in range(20)]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(make_docs(rows, extra=True), items).collect()}
    assert got == brute(rows, given)
    assert not [k for k in got if k[0] >= 900]


def test_odd_rows(make_docs, odd_rows, items):
    assert find_leaks(make_docs(odd_rows), items).collect() == []
    docs = make_docs([*odd_rows, (70, prose(1003, 24)), (None, prose(1004, 27))], extra=True)
    kept = stage_decontaminate(docs.sparkSession, docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in odd_rows}  # of two rows with a null id only the leaking one goes


def test_empty_tables(make_docs, items):
    assert find_leaks(make_docs([]), items).collect() == []
    assert find_leaks(make_docs([(1, prose(1, 30))]), items.limit(0)).collect() == []


def test_the_blocks_do_the_search(make_docs, items, monkeypatch):
    from gridlode.llm import decontaminate

    docs = make_docs([(1, prose(1004, 27)), (2, prose(1, 40))])
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == {(1, 4)}
    whole = decontaminate._block_values
    monkeypatch.setattr(decontaminate, "_block_values", lambda p, radius: F.filter(whole(p, radius), lambda b: b["block"] < 0))
    assert find_leaks(docs, items).collect() == []


def test_a_lost_run_of_one_token_is_still_found(make_docs, spark):
    words = prose(31, 300).split()
    item, leak = words.copy(), words.copy()
    item[100:126], leak[100:126] = ["---"] * 26, ["000"] * 26
    given = [(1, " ".join(item))]
    rows = [(1, " ".join(leak)), (2, prose(2, 10) + " " + " ".join(leak)), (3, " ".join(["---"] * 300))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(make_docs(rows), spark.createDataFrame(given, "item_id long, text string")).collect()}
    assert got == brute(rows, given) and len(got) == 2


def test_repeats_inside_windows_against_brute_force(make_docs, spark):
    import random

    rng = random.Random(4)
    given = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([12, 20, 21])))) for k in range(6)]
    rows = []
    for k in range(40):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 25))] + given[k % 6][1].split() + [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "d"
        rows.append((k, " ".join(words)))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(make_docs(rows), spark.createDataFrame(given, "item_id long, text string")).collect()}
    assert got == brute(rows, given)


def test_long_items_are_searched_in_linear_time(make_docs, spark):
    text = prose(8, 16_000)
    docs = make_docs([(1, prose(9, 500) + " " + text + " tail"), (2, prose(10, 16_000))])
    got = find_leaks(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.window_start, r.similarity) for r in got] == [(1, 500, 1.0)]


def test_no_python_in_the_plan(make_docs, items):
    plan = find_leaks(make_docs([(1, "a b")]), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
