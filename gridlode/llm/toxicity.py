"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of lexicon words and lexicon stems, their share of lines and their closeness to
second-person words, shares of capitals and of capital words, exclamation, question and other marks, rates of obfuscated words
(letters with digits or marks between, or letters spelled apart) and of obfuscated lexicon words, length.

The lexicon is learned: words, and the first 4 to 8 letters of longer words (stems), that occur in toxic labelled rows far more often than
in clean ones. Only labelled rows whose crc32(doc_id as text) mod 5 is not 0 are used, at most MAX_LABELLED of them
(the smallest by a hash of doc_id): 2 of 5 parts for the lexicon, 2 for the trees, 1 for the calibration, so that
the trees see lexicon features as they are on new rows. Labels, lang, source and doc_id are no features. Every
document is scored.

Defined results: null and empty texts are scored on zero features; without usable labels of both kinds every score is the
share of toxic labels (0 without labels); rows that repeat a doc_id are scored one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import BoostedTrees, Isotonic, sigmoid
from .textkit import text_ranges

MAX_LABELLED = 40_000
STEM = range(4, 9)
#: A word or stem is learned from this many toxic rows on, if its log odds are over LEAST_GAIN.
LEAST_TOXIC, LEAST_GAIN = 3, 2.5
#: So much of the trees' own score at most is added to a calibrated one, to order rows within a step.
TIE = 1e-6
NEAR = 4
#: Second-person words of the corpus languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "thou", "tu", "toi", "te", "ton", "ta", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "ti", "tú", "usted", "ustedes", "vosotros")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!*.\-_+]+[^\W\d_]+)+")
_APART = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
_EDGES = ".,;:!?()[]{}\"'|"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
FEATURES = ("word_density", "stem_density", "words_found", "stems_found", "word_kinds", "line_share", "near_second", "second_density", "capital_share", "capital_words", "exclaims", "questions", "marks", "hidden_rate", "hidden_found", "log_words", "weight_sum", "weight_top")


class Lexicon:
    """Words and stems with their log odds, and the first four letters of stems."""

    def __init__(self, entries: dict[str, float]):
        self.words = {w: g for w, g in entries.items() if not w.startswith("~")}
        self.stems = {w[1:]: g for w, g in entries.items() if w.startswith("~")}
        self.heads = {w[:4] for w in self.stems}

    def __bool__(self) -> bool:
        return bool(self.words or self.stems)

    def stem(self, word: str) -> float:
        return max((self.stems.get(word[:k], 0.0) for k in STEM if len(word) > k), default=0.0)


def lexicon_features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    cased = _WORD.findall(text)
    n = len(cased)
    low = [w.lower() for w in cased]
    kinds_here = set(low)
    words_here = {w: lexicon.words[w] for w in kinds_here & lexicon.words.keys()}
    stems_here = {w: g for w in kinds_here if w[:4] in lexicon.heads and (g := lexicon.stem(w))}
    kinds = words_here | {w: max(g, words_here.get(w, 0.0)) for w, g in stems_here.items()}
    at = [i for i, w in enumerate(low) if w in words_here] if words_here else []
    by_stem = [i for i, w in enumerate(low) if w in stems_here] if stems_here else []
    hits = sorted({*at, *by_stem})
    second = [i for i, w in enumerate(low) if w in SECOND] if kinds_here & SECOND else []
    near = 0
    if hits and second:
        spots = np.array(second)
        where = np.searchsorted(spots, hits)
        before = np.abs(np.array(hits) - spots[np.maximum(where - 1, 0)])
        after = np.abs(np.array(hits) - spots[np.minimum(where, len(spots) - 1)])
        near = int((np.minimum(before, after) <= NEAR).sum())
    tokens = text.split()
    odd = [s for t in tokens if not t.isalpha() and not (s := t.strip(_EDGES)).isalpha()]
    hidden = [h for t in odd for h in _HIDDEN.findall(t)]
    apart = _APART.findall(text)
    plain = [re.sub(r"[\W\d_]", "", h.lower().translate(_PLAIN)) for h in hidden] + [re.sub(r"[\W\d_]", "", h.lower()) for h in hidden + apart]
    found = sum(p in lexicon.words for p in plain)
    lines = text.split("\n")
    marked = sum(any(w in kinds for w in _WORD.findall(line.lower())) for line in lines) / len(lines) if hits else 0.0
    size = max(1, len(text))
    capitals = sum(map(text.count, _CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
    return [
        len(at) / max(1, n), len(by_stem) / max(1, n), min(50, len(at)), min(50, len(by_stem)), min(30, len(kinds)), marked, near, len(second) / max(1, n), capitals / size,
        sum(len(w) > 1 and w.isupper() for w in cased) / max(1, n), text.count("!") / size, text.count("?") / size, sum(map(text.count, "#$%&*@")) / size,
        (len(hidden) + len(apart)) / max(1, n), found, np.log1p(n), min(100.0, sum(kinds.values())), max(kinds.values(), default=0.0),
    ]


SECOND = frozenset(SECOND_PERSON)


def _matrix(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    rows = [lexicon_features(t.decode("utf-8", "replace") if t else "", lexicon) for _, _, texts in text_ranges(column) for t in texts]
    return np.array(rows, dtype=float).reshape(len(column), len(FEATURES))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows with ``toxic`` and ``part`` (0 to 4), at most MAX_LABELLED; their ids are picked before texts are read."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words (and ~ with stems) of toxic rows -> log odds; each row counts once for each."""
    low = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    cut = lambda w: F.transform(F.filter(F.array(*[F.lit(k) for k in STEM]), lambda k: k < F.length(w)), lambda k: F.concat(F.lit("~"), F.substr(w, F.lit(1), k)))
    stems = F.array_distinct(F.flatten(F.transform(low, cut)))
    sums = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(sums["t"] or 0), int((sums["n"] or 0) - (sums["t"] or 0))
    if not toxic or not clean:
        return Lexicon({})
    counted = rows.select("toxic", F.explode(F.concat(low, stems)).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    gain = F.log((F.col("t") + 0.1) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    learned = counted.where(F.col("t") >= LEAST_TOXIC).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    return Lexicon({r["w"]: float(r["gain"]) for r in learned.collect()})  # words of at most MAX_LABELLED texts


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.share)
        logit = self.trees.logit(_matrix(column, self.lexicon))
        # the calibrated scores are flat beyond the outermost steps; TIE orders rows there and moves no score by more
        return (1 - TIE) * self.calibration(logit) + TIE * sigmoid(logit)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    from .store import materialize

    rows = materialize(_labelled(docs, labels), "labelled")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share")).first()
    lexicon = learn_lexicon(rows.where("part in (0, 1)"))

    def measure(batches):
        for b in batches:
            x = _matrix(b.column("text"), lexicon)
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "toxic": b.column("toxic").cast(pa.int64()), "part": b.column("part").cast(pa.int64())})

    data = rows.where("part > 1").select("text", "toxic", "part").mapInArrow(measure, "x array<double>, toxic long, part long").toPandas()  # bounded by MAX_LABELLED
    x = np.stack(data["x"].to_list()) if len(data) else np.zeros((0, len(FEATURES)))
    y, part = data["toxic"].to_numpy(dtype=float), data["part"].to_numpy()
    fit, rest = part < 4, part == 4
    share = float(counts["share"] or 0.0)
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[rest])) < 2:
        return ToxicityModel(lexicon, None, None, share)
    trees = BoostedTrees(least=max(3, min(20, len(y) // 100))).fit(x[fit], y[fit])
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.logit(x[rest]), y[rest]), share)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "score": pa.array(model.score(b.column("text")))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
