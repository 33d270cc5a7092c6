import random
import re

import numpy as np
import pytest

from gridlode.llm.components import connected_components
from gridlode.llm.minhash_dedup import fast_similarity_sketch, near_duplicates, stage_near_dedup

from corpus_samples import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def edits(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [80, 85])
def test_families_against_brute_force(make_docs, percent):
    rows = []
    for family in range(6):
        base = prose(family, 150)
        rows += [(100 * family + k, edits(base, 1000 * family + k, k % 5)) for k in range(25)]
    rows += [(900 + k, prose(77, 40).upper() if k % 2 else prose(77, 40)) for k in range(4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows, extra=True), percent).collect()}
    assert got == brute(rows, percent)


def test_odd_rows(make_docs, odd_rows):
    got = near_duplicates(make_docs(odd_rows)).collect()
    want = brute([r for r in odd_rows if r[0] is not None], 80)
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


def test_stage_keeps_one_of_each_group_and_all_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows, extra=True)
    kept = stage_near_dedup(docs.sparkSession, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, None], key=str)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = items[:240], items[60:]
    table = fast_similarity_sketch(np.repeat([0, 1, 2], [240, 240, 2]), np.concatenate([a, b, items[:2]]), 3)
    assert abs((table[0] == table[1]).mean() - 180 / 300) < 0.08
    assert (table != np.uint64(2**64 - 1)).all()  # every coordinate is filled, for two items as well


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1400), 1000), 5000: 5000, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def thue_morse(a, b, n=1024):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_a_rolling_hash_confuses_are_not_linked(make_docs):
    rows = [(1, thue_morse("a", "b")), (2, thue_morse("b", "a"))]
    assert {r.doc_id: r.component_id for r in near_duplicates(make_docs(rows)).collect()} == {1: 1, 2: 2}


def test_equal_sets_of_other_texts_are_linked(make_docs):
    rows = [(1, "x y z " * 10), (2, "x y z " * 11), (3, "a b c " * 10)]
    assert {r.doc_id: r.component_id for r in near_duplicates(make_docs(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_one_doc_id_with_two_texts_is_one_document(make_docs):
    a, b = prose(1, 60), prose(2, 60)
    docs = make_docs([(5, a), (5, b), (3, a), (9, b), (11, prose(3, 60))])
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]
    docs = make_docs([(5, a), (5, b), (5, a), (9, b + " more")])
    kept = stage_near_dedup(docs.sparkSession, docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b)])


def test_heavy_keys_are_salted(spark, monkeypatch):
    from gridlode.llm import skew

    monkeypatch.setattr(skew, "HEAVY", 10)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, x long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    plain = sorted(left.join(right, "k").collect())
    assert sorted(skew.join_counted(left, right, ["k"], "n", 300).select("k", "x", "n").collect()) == plain
    assert sorted(skew.salted_join(left, right, "k", "x", skew.heavy_copies(left, "k", 300)).select("k", "x", "n").collect()) == plain
