"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Documents are counted into cells (source, language, topic) of tokens. Raking multiplies the cells' weights until their
marginals are the targets: one sweep scales by source, by language and by topic, and sweeps go on until no marginal is
off by more than TOLERANCE, or until they no longer bring the worst marginal nearer: targets that cannot all be met, because cells
that they need do not occur, leave a gap. The worst gap is a result (``marginal_gap``), a warning names it, and with
``strict`` it is an error. A cell's documents are then drawn with probability min(1, scale * weight / tokens), by a hash of
doc_id, so that a draw is repeatable and needs no shuffle. ``scale`` is as large as it can be while cells that hold
99 % of the tokens need no more documents than there are; cells beyond that keep all their documents.

Targets: ``{"source": {"src0": 0.2, ...}, ...}`` as shares, or an exponent for a dimension, which flattens the shares of
the input (1 leaves them, 0 makes them equal). Values that a given target omits have share 0. Given targets are scaled to
sum 1 over the values that occur; a target of which no value with a positive share occurs leaves its dimension's shares as they are.

The cells are one row for each combination that occurs: raking shuffles cells and never documents. The
cells are broadcast to the documents only if they are MAX_CELLS at most; beyond that the join shuffles.

Topics come from the text's form (share of pipes, symbols and capitals, length), since documents carry no topic.

Defined results: null source, language and text count as empty strings; a text without words has no tokens and
probability 0; repeated rows and rows with one doc_id are drawn together; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import _SEPARATORS
from .store import materialize

DIMENSIONS = ("source", "lang", "topic")
TARGETS = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Sweeps between two tests of the marginals; they go on as long as these bring the worst gap down by PROGRESS of itself.
SWEEPS_A_WRITE = 4
PROGRESS = 0.02
TOLERANCE = 1e-4
MAX_CELLS = 50_000
SCALE_SHARE = 0.99
SEED = 20240607


def count_tokens(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SEPARATORS))).cast("long")


def topic_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, chars, ""))) / size
    return (
        F.when(share(r"\|+") > 0.02, "table").when(share(r"[#$%&*]+") > 0.05, "symbols").when(share(r"[A-Z]+") > 0.4, "capitals")
        .when(size < 600, "note").when(size < 4000, "article").otherwise("long")
    )


def _facts(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic_of(F.col("text")).alias("topic")]


def _targets(cells: DataFrame, dimension: str, wanted: float | dict) -> DataFrame:
    """(value, target) for the values that occur; targets sum to 1."""
    shares = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    if isinstance(wanted, dict):
        table = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))]) if wanted else F.create_map().cast("map<string,double>")
        shares = shares.withColumn("n", F.coalesce(F.try_element_at(table, F.col("value")), F.lit(0.0)))
    else:
        shares = shares.withColumn("n", F.pow(F.col("n").cast("double"), F.lit(float(wanted))))
    total = shares.agg(F.sum("n")).first()[0]
    if total is None or not total > 0:
        return _targets(cells, dimension, 1.0) if isinstance(wanted, dict) else shares.select(F.col("value").alias(dimension), F.col("n").alias(f"t_{dimension}"))
    return shares.select(F.col("value").alias(dimension), (F.col("n") / F.lit(float(total))).alias(f"t_{dimension}"))


def marginal_gap(cells: DataFrame) -> float:
    """The largest difference between a marginal of the weights and its target."""
    off = None
    for d in DIMENSIONS:
        m = cells.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"t_{d}").alias("t")).select(F.abs(F.col("w") - F.col("t")).alias("off"))
        off = m if off is None else off.union(m)
    return off.agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, float | dict] | None = None, strict: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``weight``: tokens of the mix, as a share of all, and ``marginal_gap``."""
    targets = TARGETS | (targets or {})
    work = cells.where("tokens > 0").select(*DIMENSIONS, "tokens", F.col("tokens").cast("double").alias("weight"))
    for d in DIMENSIONS:
        work = work.join(_targets(cells, d, targets[d]), d)
    work, gap = materialize(work, "cells"), float("inf")
    while True:
        for _ in range(SWEEPS_A_WRITE):
            for d in DIMENSIONS:
                has = F.sum("weight").over(Window.partitionBy(d))
                work = work.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{d}"), has), F.lit(0.0)))
        work = materialize(work, "cells")
        before, gap = gap, marginal_gap(work)
        if gap <= TOLERANCE:
            break
        if gap > before * (1 - PROGRESS):
            told = f"the targets cannot all be met: the worst marginal is off by {gap:.4f}"
            if strict:
                raise ValueError(told)
            warnings.warn(told, stacklevel=2)
            break
    return work.withColumn("marginal_gap", F.lit(float(gap)))


def _drawn(doc_id: Column, probability: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) < probability


def _held(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= MAX_CELLS else cells


def mix(docs: DataFrame, targets: dict[str, float | dict] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled, marginal_gap) for each row of ``docs``."""
    facts = materialize(docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), count_tokens(F.col("text")).alias("tokens")), "facts")
    keyed = facts.select("doc_id", *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in DIMENSIONS], "tokens")
    counts = materialize(keyed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "counts")
    cells = _probabilities(counts, targets)
    known = keyed.join(_held(cells.select(*DIMENSIONS, "probability", "marginal_gap")), list(DIMENSIONS), "left")
    p = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return known.select("doc_id", *DIMENSIONS, "tokens", p.alias("probability"), _drawn(F.col("doc_id"), p, seed).alias("sampled"), "marginal_gap")


def _probabilities(cells: DataFrame, targets: dict[str, float | dict] | None) -> DataFrame:
    work = rake(cells, targets).withColumn("ratio", F.col("weight") / F.col("tokens"))
    scale = work.agg(F.percentile("ratio", F.lit(SCALE_SHARE), F.col("tokens")).alias("top")).first()[0]
    ratio = F.col("ratio") / F.lit(float(scale)) if scale else F.lit(0.0)
    return materialize(work.select(*DIMENSIONS, "tokens", "weight", "marginal_gap", F.least(F.lit(1.0), ratio).alias("probability")), "mix")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, targets: dict[str, float | dict] | None = None, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns; texts are read twice and not shuffled."""
    counted = docs.select(*_facts(docs), count_tokens(F.col("text")).alias("tokens"))
    cells = _probabilities(materialize(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "counts"), targets)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    chosen = docs.select(row, *_facts(docs)).join(_held(cells.select(*DIMENSIONS, "probability")), list(DIMENSIONS))
    words = F.length(F.btrim(F.coalesce("row.text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) > 0
    return chosen.where(words & _drawn(F.col("row.doc_id"), F.col("probability"), seed)).select("row.*")
