"""Quality classification by co-training of two views.

The text view sees dense features of the content (byte classes, repetition, words, lines, and the shares of WORD_SLOTS
hashed words and as many hashed pairs of words); the metadata view sees only the page's columns: language, source and size. Each
view has a logistic classifier, fitted on labelled rows. Over ROUNDS rounds each view labels the unlabelled documents of
which it is most confident (SHARE_A_ROUND of all, in the proportion of the classes) for the other view, and both are
fitted again. A view gives labels of a class only while those that it would give are right on TRUST of labelled rows
kept apart for this, so a view that knows no more than the classes' shares teaches nothing; and a fit
that such rows show to be worse than the view's last is taken back. Each view is then calibrated, a last logistic model on the two calibrated logits scores every document, and
the cut is set, each on labelled rows of its own that no fit has seen.

The pool is every unlabelled document. Its features are written once; a round is one pass for the histograms of the logits,
which give the bounds of the most confident share, and one pass for each Newton step, which brings only sums of
derivatives to the driver. What a row was given follows from the earlier rounds' coefficients and bounds, so no state is kept.

A document is kept if its score is at least the cut: 0.5, or lower if 0.5 would reject more than ONE_IN of the good
rows kept for the cut. At most MAX_LABELLED labelled rows are used for fitting (the smallest by a hash of doc_id), and all
unlabelled ones with a doc_id; every document is scored, with its whole text.

Defined results: null and empty texts have zero text features; null columns are values of their own; without labels of
both kinds every score is the share of good labels (1 without labels) and everything is kept; rows that repeat a
doc_id are scored one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Logistic, sigmoid
from .store import materialize, tidy
from .textkit import Words, mix, run_hashes, text_ranges

MAX_LABELLED = 20_000
ROUNDS = 5
TRUST, LEAST_TRUSTED = 0.98, 5
#: Tenths of the labelled rows: for fitting, for trust, for calibration, for the joint model; the rest is for the cut.
TENTHS = (5, 1, 1, 1)
SHARE_A_ROUND = 0.04
ONE_IN = 400
#: A view is confident below 0.1 and above 0.9; its logits, cut at LARGEST, are counted in BINS.
CONFIDENT = float(np.log(9))
LARGEST = 40
BINS = 4_096
GIVEN_WEIGHT = 0.5
NEWTON_STEPS = 25
NEAR_ENOUGH = 1e-3
SOURCE_SLOTS = 64
LANG_SLOTS = 16
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!", b"?", b"|", b"#$%&*@^~_=+<>[]{}\\/`")
WORD_SLOTS = 32
DENSE = 22
TEXT_FEATURES = DENSE + 2 * WORD_SLOTS


def text_features(column: pa.Array) -> np.ndarray:
    """(n, TEXT_FEATURES) of a column of texts: shares of byte classes, repetition of words, word and line lengths; bounded and scale-free."""
    out = np.zeros((len(column), TEXT_FEATURES))
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, c in enumerate(_CLASSES):
        table[list(c), k] = 1
    table[128:, -1] = 1
    for begin, end, texts in text_ranges(column):
        some = [t or b"" for t in texts]
        sizes = np.array([len(t) for t in some])
        raw = np.frombuffer(b"".join(some), dtype=np.uint8)
        owner = np.repeat(np.arange(len(some)), sizes)
        counts = np.bincount(owner * 256 + raw, minlength=256 * len(some)).reshape(-1, 256)
        shares = counts @ table / np.maximum(1, sizes)[:, None]
        words = Words(some)
        n = words.counts
        safe = np.maximum(1, n)
        doc = np.repeat(np.arange(len(some)), n)
        again = np.zeros(len(words.hash), dtype=bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
        skip = np.zeros(len(words.hash), dtype=bool)
        skip[2:] = (words.hash[2:] == words.hash[:-2]) & (doc[2:] == doc[:-2])
        order = np.lexsort((words.hash, doc))
        h, d = words.hash[order], doc[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        kinds = np.bincount(d[first], minlength=len(some))
        runs = np.diff(np.append(np.flatnonzero(first), len(h))) if len(h) else np.zeros(0, dtype=int)
        top = np.zeros(len(some))
        if len(runs):
            np.maximum.at(top, d[first], runs)
        lines = np.array([t.count(b"\n") + 1 for t in some])
        x = out[begin:end]
        x[:, : shares.shape[1]] = shares
        x[:, 11] = np.bincount(doc[again], minlength=len(some)) / safe
        x[:, 12] = np.bincount(doc[skip], minlength=len(some)) / safe
        x[:, 13] = kinds / safe
        x[:, 14] = top / safe
        x[:, 15] = sizes / safe / 10
        x[:, 16] = np.log1p(n) / 10
        x[:, 17] = np.log1p(sizes / lines) / 10
        x[:, 18] = np.log1p(lines) / 10
        x[:, 19] = (n == 0) + 0.5 * (n < 5)
        x[:, 20] = kinds / np.sqrt(safe) / 10
        x[:, 21] = shares[:, 0] / np.maximum(1e-6, shares[:, 0] + shares[:, 1])
        slot = lambda owner, hashes: np.bincount(owner * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS * len(some)).reshape(-1, WORD_SLOTS) / safe[:, None]
        x[:, DENSE : DENSE + WORD_SLOTS] = slot(doc, words.hash)
        pairs = words.inside(2)
        if len(pairs):
            x[:, DENSE + WORD_SLOTS :] = slot(doc[pairs], run_hashes(words.hash, 2)[pairs])
    return out


def _slots(values: list, slots: int) -> np.ndarray:
    found = {v: zlib.crc32(str(v).encode()) % slots for v in set(values)}
    return np.array([found[v] for v in values], dtype=np.int32)


def meta_matrix(lang: np.ndarray, source: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Of slots of language and source, and sizes (NaN where null)."""
    out = np.zeros((len(lang), LANG_SLOTS + SOURCE_SLOTS + 6))
    at = np.arange(len(lang))
    out[at, lang] = 1
    out[at, LANG_SLOTS + source] = 1
    c = np.nan_to_num(n_chars)
    size = np.log1p(np.maximum(0, c)) / 10
    out[:, LANG_SLOTS + SOURCE_SLOTS :] = np.stack([size, size**2, np.isnan(n_chars), c < 40, c < 200, c > 20_000], axis=1)
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    return meta_matrix(_slots(lang, LANG_SLOTS), _slots(source, SOURCE_SLOTS), np.array([np.nan if c is None else c for c in n_chars], dtype=float))


class QualityModel:
    def __init__(self, share: float):
        self.share, self.views, self.cut, self.pool_rows, self.history = share, None, 0.0, 0, []

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(n, 3): the two calibrated views and the combination."""
        if self.views is None:
            return np.full((len(text), 3), self.share)
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)]
        return np.stack([sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(self.joint.logit(np.stack(logits, axis=1)))], axis=1)


def _bins(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + LARGEST) * (BINS / (2 * LARGEST)), 0, BINS - 1).astype(int)


def given_labels(z: list[np.ndarray], draw: np.ndarray, history: list) -> list[np.ndarray]:
    """For each view, the label that the other one gave a row in the rounds of ``history``, or -1. ``draw``, from 0 to 1, decides within the last bin."""
    given = [np.full(len(draw), -1.0), np.full(len(draw), -1.0)]
    for coefs, bounds in history:
        for v, (low, low_share, high, high_share) in enumerate(bounds):
            logit = z[v] @ coefs[v]
            at, mine = _bins(logit), given[1 - v]
            free = mine < 0
            mine[free & (logit < -CONFIDENT) & ((at < low) | ((at == low) & (draw < low_share)))] = 0.0
            mine[free & (logit > CONFIDENT) & ((at > high) | ((at == high) & (draw < high_share)))] = 1.0
    return given


def _count(z: list[np.ndarray], draw: np.ndarray, history: list, coefs: list[np.ndarray]) -> np.ndarray:
    """For each view, the histogram of the logits of which it is confident, over rows that the other view was not given."""
    given = given_labels(z, draw, history)
    out = np.zeros((2, BINS))
    for v in (0, 1):
        logit = (z[v] @ coefs[v])[given[1 - v] < 0]
        out[v] = np.bincount(_bins(logit[np.abs(logit) > CONFIDENT]), minlength=BINS)
    return out.ravel()


def _derive(z: list[np.ndarray], draw: np.ndarray, history: list, views: list[Logistic]) -> np.ndarray:
    """The sums of both views over the rows that they were given."""
    out = []
    for view, x, marks in zip(views, z, given_labels(z, draw, history), strict=True):
        x, marks = x[marks >= 0], marks[marks >= 0]
        weight = np.full(len(marks), GIVEN_WEIGHT)
        slope, curve = view.sums(x, marks, weight)
        out += [[view.loss(x, marks, weight)], slope, curve.ravel()]
    return np.concatenate(out)


def _moments(x: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[float(len(x[0]))], *[f for m in x for f in (m.sum(axis=0), (m**2).sum(axis=0))]])


def most_confident(histogram: np.ndarray, bad: int, good: int) -> tuple[int, float, int, float]:
    """Bin and share of it up to which the lowest ``bad`` logits go, and from which the highest ``good``."""
    ends = []
    for counts, wanted in ((histogram[: BINS // 2], bad), (histogram[: BINS // 2 - 1 : -1], good)):
        total = np.cumsum(counts)
        at = int(np.searchsorted(total, wanted))
        ends += [at, 1.0 if at == len(counts) else float((wanted - (total[at] - counts[at])) / max(1, counts[at]))]
    return ends[0], ends[1], BINS - 1 - ends[2], ends[3]


class ArrayPool:
    """Unlabelled rows as arrays: ``gather`` sums a function of both views' features and the draws."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, draw: np.ndarray):
        self.parts = (text, meta, draw)

    def gather(self, f) -> np.ndarray | float:
        return f([self.parts[0], self.parts[1]], self.parts[2]) if len(self.parts[2]) else 0.0


class TablePool:
    """The same of a table of features: each task sends one row of sums."""

    def __init__(self, table: DataFrame):
        self.table = table

    def gather(self, f) -> np.ndarray | float:
        def run(batches):
            total = 0.0
            for b in batches:
                if b.num_rows:
                    total = total + f(list(_measured(b)), draws(b.column("doc_id").to_numpy()))
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        tidy(self.table.sparkSession)
        return sum((np.frombuffer(r["sums"]) for r in self.table.mapInArrow(run, "sums binary").collect()), 0.0)


def draws(doc_id: np.ndarray) -> np.ndarray:
    """From 0 to 1, by a hash of doc_id."""
    return mix(doc_id.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) / 2.0**64


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """Masks of the rows for fitting, trust, calibration, the joint model and the cut; a part without both classes is all that are not for fitting."""
    tenth = np.arange(len(y)) % 10
    cuts = np.cumsum([0, *TENTHS, 10 - sum(TENTHS)])
    parts = [(tenth >= i) & (tenth < j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return [parts[0], *[m if len(np.unique(y[m])) == 2 else ~parts[0] for m in parts[1:]]]


def _trusted(logit: np.ndarray, y: np.ndarray) -> tuple[bool, bool]:
    """Whether a view's confident labels of bad and of good rows are right often enough."""
    sides = ((logit < -CONFIDENT, y == 0), (logit > CONFIDENT, y == 1))
    return tuple(bool(sure.sum() >= LEAST_TRUSTED and right[sure].mean() >= TRUST) for sure, right in sides)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: ArrayPool | TablePool, rounds: int = ROUNDS) -> QualityModel:
    """Labelled rows are in a random order; a half of them is kept for trust, calibration, the joint model and the cut."""
    model = QualityModel(float(y.mean()) if len(y) else 1.0)
    fit, trust, calibrate, join, cut = _parts(y)
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[~fit])) < 2:
        return model
    good = y[fit].mean()
    sums = _moments([text[fit], meta[fit]])
    unlabelled = pool.gather(lambda x, draw: _moments(x))
    n = int(unlabelled[0]) if np.ndim(unlabelled) else 0
    sums, views, at = sums + unlabelled, [], 1
    for k in (text.shape[1], meta.shape[1]):
        mean, square = sums[at : at + k] / sums[0], sums[at + k : at + 2 * k] / sums[0]
        views.append(Logistic().begin(mean, np.sqrt(np.maximum(0, square - mean**2)) + 1e-9))
        at += 2 * k
    labelled = [v._design(x[fit]) for v, x in zip(views, (text, meta), strict=True)]
    watched = [v._design(x[trust]) for v, x in zip(views, (text, meta), strict=True)]
    history: list = []
    lasts: list = [None, None]
    for r in range(rounds + 1):
        best: list[list] = [[], []]
        for _ in range(NEWTON_STEPS):
            added = pool.gather(lambda x, draw: _derive([v._design(m) for v, m in zip(views, x, strict=True)], draw, history, views)) if history else 0.0
            at, moved = 0, 0.0
            for view, z, kept in zip(views, labelled, best, strict=True):
                ones = np.ones(len(z))
                loss, (slope, curve) = view.loss(z, y[fit], ones), view.sums(z, y[fit], ones)
                k = len(slope)
                if np.ndim(added):
                    loss, slope, curve = loss + added[at], slope + added[at + 1 : at + 1 + k], curve + added[at + 1 + k : at + 1 + k + k * k].reshape(k, k)
                at += 1 + k + k * k
                moved = max(moved, view.guarded_step(loss, slope, curve, kept))
            if moved < (NEAR_ENOUGH if history else 1e-6):
                break
        for v, (view, z) in enumerate(zip(views, watched, strict=True)):
            loss = view.loss(z, y[trust], np.ones(len(z)))
            if lasts[v] is not None and loss > lasts[v][0]:
                view.coef = lasts[v][1]
            else:
                lasts[v] = (loss, view.coef)
        if r == rounds or not n:
            break
        allowed = [_trusted(z @ view.coef, y[trust]) for view, z in zip(views, watched, strict=True)]
        if not any(map(any, allowed)):
            break
        counts = pool.gather(lambda x, draw: _count([v._design(m) for v, m in zip(views, x, strict=True)], draw, history, [v.coef for v in views])).reshape(2, BINS)
        take = max(1, int(SHARE_A_ROUND * n))
        bad = max(1, round(take * (1 - good)))
        bounds = []
        for c, (bad_too, good_too) in zip(counts, allowed, strict=True):
            low, low_share, high, high_share = most_confident(c, bad, take - bad)
            bounds.append((*((low, low_share) if bad_too else (-1, 0.0)), *((high, high_share) if good_too else (BINS, 0.0))))
        history.append(([v.coef for v in views], bounds))
    model.pool_rows, model.history = n, history
    model.views = views
    logits = [v.logit(x)[:, None] for v, x in zip(views, (text, meta), strict=True)]
    model.calibrations = [Logistic(l2=0.1).fit(z[calibrate], y[calibrate]) for z in logits]
    both = np.stack([c.logit(z) for c, z in zip(model.calibrations, logits, strict=True)], axis=1)
    model.joint = Logistic(l2=0.1).fit(both[join], y[join])
    score = sigmoid(model.joint.logit(both[cut]))
    model.cut = float(min(0.5, np.quantile(score[y[cut] == 1], 1 / ONE_IN)))
    return model


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _both(b) -> tuple[np.ndarray, np.ndarray]:
    return text_features(b.column("text")), meta_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _measured(b) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch of the table of features."""
    whole = lambda c: x.combine_chunks() if isinstance(x := b.column(c), pa.ChunkedArray) else x
    lang, source, n_chars = (whole(c).to_numpy(zero_copy_only=False) for c in ("lang", "source", "n_chars"))
    return whole("text").flatten().to_numpy().reshape(-1, TEXT_FEATURES), meta_matrix(lang, source, n_chars)


def feature_table(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of all rows with a doc_id, with ``quality`` (null if unlabelled), and the ids of the labelled rows to fit on."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))

    def measure(batches):
        for b in batches:
            sizes = [np.nan if c is None else float(c) for c in b.column("n_chars").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.int64()), "text": pa.array(list(text_features(b.column("text"))), pa.list_(pa.float64())),
                "lang": _slots(b.column("lang").to_pylist(), LANG_SLOTS), "source": _slots(b.column("source").to_pylist(), SOURCE_SLOTS), "n_chars": pa.array(sizes, pa.float64()),
            })

    features = _columns(docs).where("doc_id is not null").mapInArrow(measure, "doc_id long, text array<double>, lang int, source int, n_chars double")
    return materialize(features.join(marks, "doc_id", "left"), "features"), marks.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    table, picked = feature_table(docs, labels)
    # MAX_LABELLED ids are broadcast at most, and so many rows of features come to the driver
    rows = table.where("quality is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "quality").toArrow()
    if not rows.num_rows:
        return QualityModel(1.0)
    order = np.argsort(mix(rows.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
    text, meta = _measured(rows)
    y = rows.column("quality").to_numpy().astype(float)[order]
    text, meta, rows = text[order], meta[order], None
    return co_train(text, meta, y, TablePool(table.where("quality is null").drop("quality")))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for each row of ``docs``."""

    def run(batches):
        for b in batches:
            s = model.scores(*_both(b))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "text_score": s[:, 0], "meta_score": s[:, 1], "score": s[:, 2], "kept": s[:, 2] >= model.cut})

    return _columns(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns: one pass over the texts, no shuffle."""
    model = fit_quality(docs, labels)

    def run(batches):
        for b in batches:
            text = text_features(b.column("text"))
            meta = meta_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield b.filter(pa.array(model.scores(text, meta)[:, 2] >= model.cut))

    return docs.mapInArrow(run, docs.schema)
