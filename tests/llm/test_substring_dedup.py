import random
import re

from gridlode.llm.substring_dedup import substring_dedup

from corpus_samples import prose


def brute(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        keep = [True] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                keep[k : k + window] = [False] * window
            seen.add(key)
        kept = [w for w, ok in zip(words, keep, strict=True) if ok]
        out.append((i, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def run(df, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, **more).collect()), key=str)


def test_odd_rows(make_docs, odd_rows):
    assert run(make_docs(odd_rows)) == brute(odd_rows)


def test_shared_passages_against_brute_force(make_docs):
    rng = random.Random(3)
    passages = [prose(k, rng.randint(15, 90)) for k in range(8)]
    rows = [(i, " ".join([prose(100 + i, rng.randint(0, 40)), rng.choice(passages), prose(500 + i, rng.randint(0, 30)), rng.choice(passages)])) for i in range(120)]
    assert run(make_docs(rows, extra=True), buckets=7, parts=3) == brute(rows)


def test_one_text_for_a_third_of_the_rows(make_docs):
    rows = [(i, prose(1, 50) if i % 3 == 0 else prose(i, 50)) for i in range(150)]
    assert run(make_docs(rows)) == brute(rows)


def test_spans_are_maximal(make_docs):
    text = prose(2, 70)
    got = {r.doc_id: r for r in substring_dedup(make_docs([(1, text), (2, "new words " + text)])).collect()}
    assert [(s.start, s.end) for s in got[2].removed_spans] == [(2, 72)] and got[1].removed_spans == []


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def thue_morse(a, b, n=1024):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_a_rolling_hash_confuses_stay(make_docs):
    head, tail = " ".join(f"w{k}" for k in range(10)), " ".join(f"w{k}" for k in range(10, 30))
    rows = [(1, f"{head} {thue_morse('a', 'b')} {tail}"), (2, f"z {head} {thue_morse('b', 'a')} {tail}")]
    got = run(make_docs(rows))
    assert got == brute(rows) and [r[2] for r in got] == [0, 20]


def test_equal_hashes_of_other_words_end_in_an_error():
    import numpy as np
    import pytest
    from gridlode.llm.substring_dedup import _equal

    with pytest.raises(RuntimeError):
        _equal(np.array([1, 2, 3, 1, 2, 4]), np.array([0]), np.array([3]), 3)


def test_a_passage_in_every_bucket_is_lent_along_a_tree(make_docs):
    passage = prose(7, 45)
    rows = [(i, f"{prose(1000 + i, 12)} {passage} {prose(2000 + i, 9)}") for i in range(90)]
    assert run(make_docs(rows), buckets=60, parts=4) == brute(rows)


def test_rows_that_share_a_doc_id(make_docs):
    rows = [(None, prose(1, 40)), (3, prose(2, 30)), (3, prose(2, 30)), (None, prose(1, 40)), (3, prose(1, 40))]
    got = run(make_docs(rows))
    assert sorted((r[0] is None, r[2]) for r in got) == [(False, 0), (False, 0), (False, 30), (True, 40), (True, 40)]
