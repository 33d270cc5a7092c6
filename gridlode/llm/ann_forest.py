"""Nearest neighbours by largest inner product with a hash-prefix forest.

Vectors are lifted to the unit sphere (one more coordinate makes all lengths equal), where the largest inner product
is the smallest angle. A tree gives each vector a string of 64 hyperplane signs; the strings of a tree lie in one
sorted array. A query descends in every tree to its longest matching prefix by binary search, and then all trees
ascend together, one prefix bit at a time, until the prefixes hold a share of the block's
vectors in each tree on average (LEAST of them at least). The share is the smallest of SHARES with which the block's forest
finds TARGET_RECALL of the true neighbours of SAMPLE of its own vectors, so vectors with structure need few candidates and those
without many. The candidates are scored with the original vectors in double precision.

Rows are indexed in blocks (LEAST_BLOCK to BLOCK vectors by a hash of vec_id, as many blocks as partitions if they are large enough),
each with a forest of its own in one task, and queries visit every block in blocks of QUERIES at most; a last aggregation takes the best of all blocks. Every row is indexed, equal
vectors of a block are one entry with all their ids, so that a vector which a third of the rows share costs one
candidate. The number of blocks follows the count of rows, so no task grows with the input. Every query meets every block, so
what is shuffled is rows * queries * (1 / BLOCK + 1 / QUERIES) vectors: for queries in proportion to the rows this is a quadratic
operator with a small factor, like any that asks so many queries.

Recall against brute force (20 nearest): see README; the tests ask for 0.9.

Defined results: null, empty and zero vectors and those that hold null or a non-finite number take no part; vectors are
compared with those of the same length only; ties go to the smaller vec_id; with fewer than k candidates all are
returned; rows that repeat a vec_id and vector count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, partitions

TREES = 32
BITS = 64
#: Shares of a block's distinct vectors that each tree's prefix may hold on average when the ascent stops.
SHARES = (0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.25, 1.0)
TARGET_RECALL, SAMPLE = 0.95, 48
#: So many candidates a tree at least, for each neighbour that is asked for.
LEAST = 2
BLOCK, LEAST_BLOCK = 100_000, 20_000
QUERIES, LEAST_QUERIES = 100_000, 250
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _hash_strings(unit: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, n) of uint64: 64 signs, first sign in the highest bit."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, len(unit)), dtype=np.uint64)
    for t in range(trees):
        planes = rng.standard_normal((unit.shape[1], BITS)).astype(np.float32)
        out[t] = np.packbits(unit @ planes > 0, axis=1).view(">u8").ravel()
    return out


class Forest:
    """The sorted hash strings of some vectors. ``vectors`` are distinct."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 7):
        self.trees, self.seed = trees, seed
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        top = norm.max()
        lifted = np.concatenate([vectors / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))[:, None]], axis=1).astype(np.float32)
        strings = _hash_strings(lifted, trees, seed)
        self.order = np.argsort(strings, axis=1)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the slice of the sorted array that shares the first ``depth`` bits."""
        shift = (BITS - depth).astype(np.uint64)
        whole = depth == 0
        shift[whole] = 0
        lo, hi = np.empty(strings.shape, dtype=np.int64), np.empty(strings.shape, dtype=np.int64)
        for t in range(self.trees):
            low = strings[t] >> shift << shift
            lo[t] = np.searchsorted(self.sorted[t], low)
            hi[t] = np.searchsorted(self.sorted[t], low | (np.uint64(1) << shift) - np.uint64(1), side="right")
        lo[:, whole], hi[:, whole] = 0, self.sorted.shape[1]
        return lo, hi

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the positions of its candidates."""
        norm = np.sqrt((queries * queries).sum(axis=1))
        lifted = np.concatenate([queries / norm[:, None], np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        strings = _hash_strings(lifted, self.trees, self.seed)
        # the ascent stops at the deepest level with enough candidates; counts only grow on the way up
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), BITS, dtype=np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            lo, hi = self._ranges(strings, mid)
            enough = (hi - lo).sum(axis=0) >= least
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        lo, hi = self._ranges(strings, low)
        for q in range(len(queries)):
            yield np.unique(np.concatenate([self.order[t, lo[t, q] : hi[t, q]] for t in range(self.trees)]))


    def share_for(self, vectors: np.ndarray, k: int, target: float = TARGET_RECALL, sample: int = SAMPLE) -> float:
        """The smallest share with which the sample's neighbours are found as asked."""
        asked = np.linspace(0, len(vectors) - 1, min(sample, len(vectors))).astype(int)
        scores = vectors[asked] @ vectors.T
        scores[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(vectors) - 1)
        if k < 1:
            return 1.0
        true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        for share in SHARES:
            found = self.candidates(vectors[asked], self.least(k, share, len(vectors)))
            if sum(len(np.intersect1d(f, t, assume_unique=True)) for f, t in zip(found, true, strict=True)) >= target * true.size:
                return share
        return 1.0

    def least(self, k: int, share: float, n: int) -> int:
        """Candidates of all trees together at which the ascent stops."""
        return self.trees * max(LEAST * (k + 1), round(share * n))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).astype(np.float64).reshape(n, -1)


def _search(k: int, trees: int, share: float | None):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        ids, vectors = data.column("vec_id").to_numpy(), _matrix(data.column("vector"), data.num_rows)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        rows = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        owner = np.argsort(inverse, kind="stable")  # ids of an equal vector stay ascending
        begin = np.searchsorted(inverse[owner], np.arange(len(first) + 1))
        distinct = vectors[first]
        forest = Forest(distinct, trees)
        asked, points = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), queries.num_rows)
        out_q, out_v, out_s = [], [], []
        part = forest.share_for(distinct, k) if share is None else share
        for q, found in enumerate(forest.candidates(points, forest.least(k, part, len(distinct)))):
            scores = (distinct[found] * points[q]).sum(axis=1)
            if len(found) > k + 1:
                cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                found, scores = found[scores >= cut], scores[scores >= cut]
            best_ids = [ids[owner[begin[d] : min(begin[d + 1], begin[d] + k + 1)]] for d in found]
            best = np.repeat(scores, [len(b) for b in best_ids])
            best_ids = np.concatenate(best_ids) if best_ids else np.zeros(0, dtype=np.int64)
            other = best_ids != asked[q]
            best, best_ids = best[other], best_ids[other]
            top = np.lexsort((best_ids, -best))[:k]
            out_q.append(np.full(len(top), asked[q]))
            out_v.append(best_ids[top])
            out_s.append(best[top])
        return pa.table([np.concatenate(out_q).astype(np.int64), np.concatenate(out_v).astype(np.int64), np.concatenate(out_s).astype(np.float64)], schema=_FOUND)

    return run


def _ddl() -> str:
    return "query_id long, vec_id long, score double"


def nearest(data: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, share: float | None = None, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows of ``data`` other than itself.

    Both sides have vec_id and embedding (array of numbers); other columns are ignored. ``share`` fixes the share of
    candidates. Rows that repeat a vec_id with another vector are entries of their own under that id.
    """

    def usable(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", F.col("embedding").alias("vector"), F.size("embedding").alias("dim"))

    data, queries = materialize(usable(data).distinct(), "vectors"), materialize(usable(queries).distinct(), "queries")
    rows, asking, tasks = data.count(), queries.count(), partitions(data.sparkSession)
    block = block or max(LEAST_BLOCK, min(BLOCK, -(-rows // tasks)))
    blocks = max(1, -(-rows // block))
    query_block = query_block or min(QUERIES, max(LEAST_QUERIES, -(-asking * blocks // tasks)))
    rounds = max(1, -(-asking // query_block))
    dealt = data.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    asked = queries.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(rounds)).cast("int").alias("round"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["dim", "block", "round"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, trees, share), _ddl())
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # ids that repeat
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
