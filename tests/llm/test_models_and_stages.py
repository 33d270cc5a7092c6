import numpy as np
import pytest
from corpus_samples import prose
from pyspark.sql import functions as F

from gridlode.llm import ann_forest, kd_shards, mixing, quality, toxicity
from gridlode.llm.models import BoostedTrees, Isotonic, Logistic


def test_boosted_trees_isotonic_and_logistic_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    logit = model.logit(x[2000:])
    assert ((logit > 0) == (y[2000:] == 1)).mean() > 0.93
    steps = Isotonic().fit(logit, y[2000:])
    values = steps(np.sort(logit))
    assert (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    line = Logistic().fit(x[:2000], (x[:2000] @ [1, -2, 0, 0] > 0).astype(float))
    assert ((line.logit(x[2000:]) > 0) == (x[2000:] @ [1, -2, 0, 0] > 0)).mean() > 0.97
    assert BoostedTrees().fit(x[:10], np.ones(10)).logit(x[:5]).shape == (5,)


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rows, labels = [], []
    for i in range(600):
        toxic, bad = int(i % 6 == 0), int(i % 5 == 0)
        text = prose(i, 60 + i % 40)
        if toxic:
            words = text.split()
            words[7], words[20] = "wretchbag", f"scumlord{i % 7}ly"
            text = " ".join(words)
        rows.append((i, text if not bad else " ".join(["spam!!"] * 60)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1 - bad, toxic if not bad else 0))
    return make_docs(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 30 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in got]) > 0.95


@pytest.mark.parametrize("text", ['you are an "i d i o t"', "you f o o l!", "(f o o l)", "f.o o.l"])
def test_words_spelled_apart_are_found_beside_marks(text):
    found = dict(zip(toxicity.FEATURES, toxicity.lexicon_features(text, toxicity.Lexicon({"idiot": 3.0, "fool": 3.0})), strict=True))
    assert found["hidden_found"] >= 1 and found["hidden_rate"] > 0


def test_capitals_of_all_scripts_count():
    share = toxicity.FEATURES.index("capital_share")
    assert [toxicity.lexicon_features(t, toxicity.Lexicon({}))[share] for t in ("ÉÀb", "ДАнет", "ABc", "")] == [2 / 3, 2 / 5, 2 / 3, 0]


def test_toxicity_odd_rows_and_tables(make_docs, odd_rows, labelled, spark):
    docs, labels, _ = labelled
    model = toxicity.fit_toxicity(docs, labels)
    odd = make_docs(odd_rows)
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    none = toxicity.fit_toxicity(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    assert toxicity.score_toxicity(make_docs([]), toxicity.fit_toxicity(make_docs([]), labels)).collect() == []


def test_quality_keeps_good_and_drops_bad(labelled):
    docs, labels, _ = labelled
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.05
    kept = quality.stage_quality(docs.sparkSession, docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, model).where("kept").collect()}


def test_quality_pool_is_every_unlabelled_row(spark):
    rows = spark.range(26_000).selectExpr("id AS doc_id", "CASE WHEN id % 5 = 0 THEN repeat('spam!! ', 3 + cast(id % 50 AS int)) ELSE concat('The ', id, ' quiet rivers of ', id * 7, ' towns ran on.') END AS text", "'en' AS lang", "concat('s', IF(id % 5 = 0, 9, id % 3)) AS source")
    docs = rows.selectExpr("*", "cast(length(text) AS long) AS n_chars")
    labels = rows.where("doc_id % 13 = 0").selectExpr("doc_id", "cast(doc_id % 5 <> 0 AS int) AS quality")
    model = quality.fit_quality(docs, labels)
    assert model.pool_rows == 24_000
    table, _ = quality.feature_table(docs, labels)
    pool = table.where("quality is null").toPandas()
    text, meta = np.stack(pool["text"].to_list()), quality.meta_matrix(*(pool[c].to_numpy() for c in ("lang", "source", "n_chars")))
    draw = quality.draws(pool["doc_id"].to_numpy())
    given = quality.given_labels([v._design(x) for v, x in zip(model.views, (text, meta), strict=True)], draw, model.history)
    # five rounds of 4 % of all unlabelled rows, not of a sample of them
    assert all(2_000 < (g >= 0).sum() <= 4_900 for g in given)
    # the same fit with the pool as arrays, and bounds like those of a sort
    known = table.where("quality is not null").toPandas()
    known = known.iloc[np.argsort(quality.mix(known["doc_id"].to_numpy().astype(np.uint64)), kind="stable")]
    arrays = np.stack(known["text"].to_list()), quality.meta_matrix(*(known[c].to_numpy() for c in ("lang", "source", "n_chars")))
    same = quality.co_train(*arrays, known["quality"].to_numpy(dtype=float), quality.ArrayPool(text, meta, draw))
    assert np.allclose(same.scores(text, meta), model.scores(text, meta), atol=1e-3)
    logit = np.random.default_rng(1).normal(0, 6, 5000)
    low, low_share, high, high_share = quality.most_confident(np.bincount(quality._bins(logit), minlength=quality.BINS), 300, 200)
    width = 2 * quality.LARGEST / quality.BINS
    assert abs((low + low_share) * width - quality.LARGEST - np.sort(logit)[299]) < 2 * width and abs((high + 1 - high_share) * width - quality.LARGEST - np.sort(logit)[-200]) < 2 * width


def test_quality_odd_rows_and_tables(make_docs, odd_rows, labelled):
    _, labels, _ = labelled
    odd = make_docs(odd_rows, extra=True)
    assert len(quality.score_quality(odd, quality.fit_quality(odd, labels.limit(0))).where("kept").collect()) == len(odd_rows)
    assert quality.score_quality(make_docs([]), quality.fit_quality(make_docs([]), labels)).collect() == []


def test_shards_are_even_whole_and_gapless(make_docs, odd_rows):
    rows = [(i, prose(i % 300, 20 + i % 50)) for i in range(1, 900)]
    docs = make_docs(rows, extra=True)
    got = kd_shards.shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8)) and len(got) == len(rows)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    texts = dict(rows)
    homes = {}
    for r in got:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 1
    assert all(len(h) == 1 for h in homes.values())
    staged = kd_shards.stage_shard(docs.sparkSession, docs)
    assert staged.count() == len(rows) and staged.columns[-1] == "shard"


def test_shards_of_a_hot_group_and_of_odd_rows(make_docs, odd_rows):
    same = prose(1, 30)
    got = kd_shards.shard(make_docs([(i, same if i % 3 else prose(i, 30)) for i in range(600)])).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)
    odd = kd_shards.shard(make_docs(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and {r.size for r in odd if r.doc_id in (1, 2)} == {1}
    assert kd_shards.shard(make_docs([])).collect() == []


def kd_brute(points, shards, keys):
    """The K-d split in plain Python: {row: leaf number} of rows (size, value of each dimension, low)."""
    def split(rows, k):
        if k == 1:
            return [rows]
        if not rows:
            return split([], k // 2) + split([], k - k // 2)
        total = sum(r["size"] for r in rows)
        widths = []
        for d in keys:
            by = {}
            for r in rows:
                by[r[d]] = by.get(r[d], 0) + r["size"]
            widths.append(1 - max(by.values()) / total)
        d = keys[max(range(len(keys)), key=lambda i: (widths[i], -i))]
        key = lambda r: (r[d] << 42) + (r["low"] >> 21)
        want, through, sums = total * (k // 2) // k, 0, {}
        for r in rows:
            sums[key(r)] = sums.get(key(r), 0) + r["size"]
        for at in sorted(sums):
            if through + sums[at] >= want:
                at += sums[at] - (want - through) <= want - through
                break
            through += sums[at]
        return split([r for r in rows if key(r) < at], k // 2) + split([r for r in rows if key(r) >= at], k - k // 2)

    return {r["doc_id"]: i for i, leaf in enumerate(split(points, shards)) for r in leaf}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_the_cuts_of_a_plain_kd_tree(spark, make_docs, shards):
    rows = [(i, prose(i % 250, 10 + i * 7 % 120), ["en", "de", "fr", None][i % 7 % 4], f"s{i * i % 5}", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    points = [r.asDict() for r in kd_shards._points(docs, shards).collect()]
    assert {r.doc_id: r.shard for r in kd_shards.shard(docs, shards).collect()} == kd_brute(points, shards, kd_shards.DIMENSIONS)


def test_number_of_shards_follows_target_bytes(make_docs):
    docs = make_docs([(i, "x" * 99) for i in range(50)] + [(99, None)])
    assert kd_shards.shards_for(docs, 1000) == 6 and kd_shards.shards_for(docs.limit(0), 1000) == 1


def raked(cells, targets, sweeps=4000):
    """Plain iterative proportional fitting over {(source, lang, topic): tokens}."""
    weight = {c: float(n) for c, n in cells.items() if n}
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            has = {}
            for c, w in weight.items():
                has[c[d]] = has.get(c[d], 0) + w
            weight = {c: w * target.get(c[d], 0) / has[c[d]] if has[c[d]] else 0.0 for c, w in weight.items()}
    return weight


def test_raking_against_plain_python(spark):
    rng = np.random.default_rng(5)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(1, 500)) for a in range(4) for b in range(3) for c in range(2) if rng.random() < 0.85}
    targets = {"source": {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, "lang": {"l0": 2.0, "l1": 1.0, "l2": 1.0}, "topic": {"t0": 0.5, "t1": 0.5}}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = mixing.rake(df, targets, strict=True).collect()
    want = raked(cells, [targets["source"], {k: v / 4 for k, v in targets["lang"].items()}, targets["topic"]])
    assert all(abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-3 for r in got) and len(got) == len(want)
    assert {r.marginal_gap <= mixing.TOLERANCE for r in got} == {True}


def test_targets_that_cannot_be_met_are_reported(spark):
    df = spark.createDataFrame([("a", "x", "t", 90), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    with pytest.warns(UserWarning, match="cannot all be met"):
        got = mixing.rake(df, targets).collect()
    assert got[0].marginal_gap > 0.5
    with pytest.raises(ValueError, match="cannot all be met"):
        mixing.rake(df, targets, strict=True)


def test_targets_of_absent_values(spark):
    # values that do not occur are left out, and a target of absent values only leaves the shares
    df = spark.createDataFrame([(a, x, "t", n) for a, x, n in [("a", "x", 60), ("a", "y", 20), ("b", "x", 15), ("b", "y", 5)]], "source string, lang string, topic string, tokens long")
    got = mixing.rake(df, {"source": {"zz": 1.0}, "lang": {"x": 0.5, "y": 0.5, "zz": 7.0}, "topic": {}}, strict=True).collect()
    assert {(r.source, r.lang): round(r.weight, 6) for r in got} == {("a", "x"): 0.4, ("a", "y"): 0.4, ("b", "x"): 0.1, ("b", "y"): 0.1}


def test_mixing_reaches_its_marginals(spark):
    rows = [(i, prose(i % 50, 20 + i % 80), ["en", "de", None][i % 3], ["a", "a", "b", "c"][i % 4], 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic long")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": 0.0, "topic": 1.0}
    got = mixing.mix(docs, targets).toPandas()
    got["mass"] = got["tokens"] * got["probability"]
    by = got.groupby("source")["mass"].sum() / got["mass"].sum()
    assert abs(by["a"] - 0.2) < 0.02 and abs(by["b"] - 0.5) < 0.02
    by = got.groupby("lang")["mass"].sum() / got["mass"].sum()
    assert np.allclose(by, 1 / 3, atol=0.02)
    assert abs((got["sampled"] * got["tokens"]).sum() - got["mass"].sum()) < 0.12 * got["mass"].sum()
    staged = mixing.stage_mix(spark, docs, targets)
    assert staged.columns == docs.columns and {r.doc_id for r in staged.collect()} == set(got[got["sampled"]]["doc_id"])


def test_mixing_odd_rows_and_plan(make_docs, odd_rows):
    odd = make_docs(odd_rows, extra=True)
    got = mixing.mix(odd)
    assert got.count() == len(odd_rows)
    assert {r.probability for r in got.where("tokens = 0").collect()} == {0.0}
    assert mixing.mix(make_docs([])).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 24)).astype(np.float32)
    points[100:1100] = points[50]  # one vector for a third of the rows
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    rows += [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [1.0] * 3), (9020, [2.0] * 3), (9040, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann_forest.nearest(df, df.where("vec_id % 20 = 0"), k=10, block=1500, query_block=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hits = total = 0
    x = points.astype(float)
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(s)), -s))[:10]
        assert [g[2] for g in got[q]] == list(range(1, 11))
        assert np.allclose([g[1] for g in got[q]], s[[g[0] for g in got[q]]])
        hits, total = hits + len({g[0] for g in got[q]} & set(top.tolist())), total + 10
    assert hits / total >= 0.9
    q = 100
    assert [g[0] for g in got[q]] == [50, *range(101, 110)]  # ties go to the smaller id
    assert [g[0] for g in got[9020]] == [9005] and 9040 not in got


def test_forest_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_forest.nearest(df, df).collect() == []


def test_forest_scores_few_of_vectors_with_structure():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(200, 32))
    points = np.repeat(centers, 50, axis=0) + 0.25 * rng.normal(size=(10_000, 32))
    forest = ann_forest.Forest(points)
    share = forest.share_for(points, 20)
    asked = points[::200]
    found = list(forest.candidates(asked, forest.least(20, share, len(points))))
    true = np.argsort(-(asked @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(f.tolist()) & set(t.tolist())) / 20 for f, t in zip(found, true, strict=True)]) >= 0.9
    assert np.mean([len(f) for f in found]) < 0.2 * len(points)


def test_forest_with_clashing_columns_and_repeated_ids(spark):
    rows = [(i, [float(i % 5), 1.0], i, i, "x") for i in range(60)] + [(7, [9.0, 9.0], 0, 0, "y"), (7, [9.0, 9.0], 0, 0, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block long, round long, dim string")
    got = ann_forest.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [r.rank for r in got] == [1, 2, 3, 4, 5] * 3
    assert [(r.vec_id, r.score) for r in got if r.query_id == 20] == [(7, 9.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, y = np.arange(7.0), rng.integers(0, 2, 7).astype(float)
        # brute force: the fit at i is the largest over starts of the smallest over ends of the means of y[start:end]
        want = [max(min(y[s:e].mean() for e in range(i + 1, 8)) for s in range(i + 1)) for i in range(7)]
        steps = Isotonic().fit(x, y)
        assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(steps.y, 9))))


def test_toxic_features_against_plain_counts():
    text = "You IDIOT! you f.o.o.l are a w0rd\nclean line, fool?"
    got = dict(zip(toxicity.FEATURES, toxicity.lexicon_features(text, toxicity.Lexicon({"idiot": 3.0, "fool": 2.0, "word": 1.0, "~clea": 0.5})), strict=True))
    words = ["You", "IDIOT", "you", "f", "o", "o", "l", "are", "a", "w", "rd", "clean", "line", "fool"]
    assert got["word_density"] == 2 / len(words) and got["stem_density"] == 1 / len(words) and got["word_kinds"] == 3
    assert got["second_density"] == 2 / len(words) and got["near_second"] == 1 and got["line_share"] == 1.0
    assert got["capital_share"] == 6 / len(text) and got["capital_words"] == 1 / len(words) and got["exclaims"] == 1 / len(text) and got["questions"] == 1 / len(text)
    assert got["hidden_found"] >= 2 and got["weight_sum"] == 5.5 and got["weight_top"] == 3.0


def test_calibrated_scores_move_by_a_tie_at_most(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit_toxicity(docs, labels)
    import pyarrow as pa

    column = pa.array(["wretchbag you", "quiet rivers", None])
    plain = model.calibration(model.trees.logit(toxicity._matrix(column, model.lexicon)))
    assert np.abs(model.score(column) - plain).max() <= toxicity.TIE


def test_a_view_that_knows_nothing_teaches_nothing():
    rng = np.random.default_rng(6)
    y = (rng.random(1000) < 0.92).astype(float)
    text, meta = y[:, None] + 0.2 * rng.normal(size=(1000, 1)), rng.normal(size=(1000, 1))
    pool = quality.ArrayPool(rng.normal(size=(4000, 1)), rng.normal(size=(4000, 1)), rng.random(4000))
    model = quality.co_train(text, meta, y, pool)
    given = quality.given_labels([v._design(x) for v, x in zip(model.views, pool.parts[:2], strict=True)], pool.parts[2], model.history)
    assert (given[0] >= 0).sum() == 0 and (given[1] >= 0).sum() > 0
