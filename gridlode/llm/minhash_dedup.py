"""Near-duplicate components with fast similarity sketches, banding and exact verification.

sketch     ``COORDS`` coordinates for each set of word shingles. In round r every shingle is thrown into one hashed
           bin with a hashed value; rounds go on until every bin is full, and after COORDS rounds round r fills bin
           r - COORDS, so that each coordinate is filled for every non-empty set. Small sets get a sketch as sharp
           as large ones, and estimates concentrate as those of independent minima do.
copies     texts with the same words in the same order (SHA-256 of the lower-cased words) are one vertex: the
           smallest doc_id that has them. Equal sets of other texts are found and verified like all other links.
bands      BANDS bands of ROWS coordinates. At similarity 0.85 a pair shares no band with probability 7e-9, at 0.80
           with 3e-6.
blocks     members of a band value are compared by their sketches (one byte a coordinate) in blocks of at most
           2 * CHUNK members, so that a value which thousands share is many small tasks. Pairs of which the
           sketches agree in less than the threshold less MARGIN are passed over (about 4.5 standard deviations).
verify     first a spanning forest of the best pairs of each block, so that a group of k copies costs k exact
           checks and not k * k; then all pairs that remain between different components. A link counts only if
           the full shingle sets say so: words are numbered by their bytes and shingles by their words, no hash decides.

Defined results: null or empty texts have no shingles, stay alone and are kept; a text of 1 to 4 words is one shingle;
rows that repeat a doc_id and its text are copies; rows that repeat a doc_id with other texts are one document, which is linked if
any of its texts is; a null doc_id takes no part (component_id null, kept false).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .skew import heavy_copies, join_counted, salted_join
from .store import materialize, partitions
from .textkit import Words, batches_of, lowered, mix, shingles, text_bytes, text_ranges

SHINGLE = 5
BANDS, ROWS = 32, 5
COORDS = 640
CHUNK = 1024
MARGIN = 0.07
#: So many ids at most are broadcast (8 bytes each) to pick their texts from the scan; beyond it the join shuffles.
BROADCAST_IDS = 200_000

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fast_similarity_sketch(owner: np.ndarray, items: np.ndarray, n_sets: int, coords: int = COORDS) -> np.ndarray:
    """(n_sets, coords) of uint64; sets without items stay at the largest value. ``owner`` is sorted."""
    out = np.full(n_sets * coords, _NONE, dtype=np.uint64)
    table = out.reshape(n_sets, coords)
    for r in range(2 * coords):
        if not len(owner):
            break
        h = mix(items ^ _SEEDS[r % len(_SEEDS)])
        bins = ((h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64) if r < coords else r - coords
        np.minimum.at(out, owner * coords + bins, np.uint64(r << 32) | h & np.uint64(0xFFFFFFFF))
        left = np.unique(owner)
        open_ = np.zeros(n_sets, dtype=bool)
        open_[left] = (table[left] == _NONE).any(axis=1)
        if not open_[left].all():
            keep = open_[owner]
            owner, items = owner[keep], items[keep]
    return table


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for begin, end, texts in text_ranges(batch.column("text")):
                doc, gram = shingles(Words(texts, lower=True), n)
                size = np.bincount(doc, minlength=end - begin)
                table = fast_similarity_sketch(doc, gram, end - begin)
                key = np.zeros((end - begin, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
                key = mix(key ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                tiny = np.concatenate([(mix(table) & np.uint64(0xFF)).astype(np.uint8), np.ascontiguousarray(key).view(np.uint8).reshape(end - begin, -1)], axis=1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[begin:end], pa.int64()), "n_shingles": pa.array(size, pa.int64()),
                    "digest": pa.array([hashlib.sha256(b" ".join(lowered(t or b"").split())).digest() for t in texts], pa.binary()),
                    "bands": pa.array([k if s else [] for k, s in zip(key, size, strict=True)], pa.list_(pa.int64())),
                    "sketch": pa.array([t.tobytes() for t in tiny], pa.binary()),
                })

    return run


def _first_shared(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first band of which both have the same (whole) key."""
    keys, out = np.ascontiguousarray(sketch[:, COORDS:]).view(np.uint64), np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), 16384):
        out[i : i + 16384] = (keys[a[i : i + 16384]] == keys[b[i : i + 16384]]).argmax(axis=1)
    return out


def _agree(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, less what one-byte coordinates share by chance."""
    out, coords = np.empty(len(a)), sketch[:, :COORDS]
    for i in range(0, len(a), 16384):
        out[i : i + 16384] = (coords[a[i : i + 16384]] == coords[b[i : i + 16384]]).mean(axis=1)
    return (out - 1 / 256) / (1 - 1 / 256)


def _forest(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """The best pairs that join everything these pairs can join."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for _, a, b in sorted(pairs, reverse=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _blocks(least: float, forest: bool):
    """Rows sorted by (band, lo, hi) -> pairs that may be linked: a forest of each block, or all between components."""

    def pairs_of(group: np.ndarray, cross: np.ndarray, chunk, comp, number, sketch):
        """group: start offsets (with the end) of complete blocks."""
        sizes = np.diff(group)
        for size in np.unique(sizes[sizes > 1]):
            which = np.flatnonzero(sizes == size)
            i, j = np.triu_indices(size, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(which), step):
                at = group[which[k : k + step]][:, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                block = np.repeat(which[k : k + step], len(i))
                keep = ~cross[block] | (chunk[a] != chunk[b])
                if not forest:
                    keep &= comp[a] != comp[b]
                a, b, block = a[keep], b[keep], block[keep]
                if not forest and len(a):  # a pair that meets in several bands is told in the first
                    keep = _first_shared(sketch, a, b) == number[a]
                    a, b, block = a[keep], b[keep], block[keep]
                near = _agree(sketch, a, b)
                ok = near >= least
                yield a[ok], b[ok], block[ok], near[ok]

    def run(batches):
        tail = None
        for batch in _with_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if table is not None:
                tail = table if tail is None else pa.concat_tables([tail, table])
            if tail is None or not tail.num_rows:
                continue
            cols = [tail.column(c).to_numpy() for c in ("band", "lo", "hi")]
            new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])
            starts = np.flatnonzero(new)
            if batch is not None:
                if len(starts) < 2 and tail.num_rows < 8 * CHUNK:
                    continue
                stop = int(starts[-1])  # the last block may go on in the next batch
                group = starts
            else:
                stop, group = tail.num_rows, np.append(starts, tail.num_rows)
            if len(group) > 1:
                doc, chunk, comp, number = (tail.column(c).to_numpy() for c in ("doc_id", "chunk", "comp", "number"))
                raw = tail.column("sketch").slice(0, stop).combine_chunks()
                raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
                sketch = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(stop, -1)
                cross = cols[1][group[:-1]] != cols[2][group[:-1]]
                waiting: dict[int, list] = {}
                outs: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b, block, near in pairs_of(group, cross, chunk, comp, number, sketch):
                    x, y = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
                    if forest:
                        count = np.bincount(block, minlength=1)[block]
                        outs.append((x[count == 1], y[count == 1]))
                        for k in np.flatnonzero(count > 1):
                            waiting.setdefault(int(block[k]), []).append((float(near[k]), int(x[k]), int(y[k])))
                    else:
                        outs.append((x, y))
                found = [p for block in waiting.values() for p in _forest(block)]
                outs.append((np.array([p[0] for p in found], dtype=np.int64), np.array([p[1] for p in found], dtype=np.int64)))
                both = np.unique(np.stack([np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])], axis=1), axis=0)
                both = both[both[:, 0] != both[:, 1]]
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIR)
            tail = tail.slice(stop)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _verify(n: int, percent: int):
    def run(batches):
        for batch in batches:
            left, right = text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            texts = [t for pair in zip(left, right, strict=True) for t in pair]
            ok = np.zeros(len(a), dtype=bool)
            for begin, end in _even(batches_of(texts)):
                doc, gram = shingles(Words(texts[begin:end], lower=True), n, exact=True)
                size = np.bincount(doc, minlength=end - begin)
                pair = doc // 2
                order = np.lexsort((gram, pair))
                pair, gram = pair[order], gram[order]
                same = (pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1])
                both = np.bincount(pair[1:][same], minlength=(end - begin) // 2)
                union = size[0::2] + size[1::2] - both
                ok[begin // 2 : end // 2] = (union > 0) & (100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], schema=_PAIR)

    return run


def _even(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ranges, cut between pairs."""
    out, begin = [], 0
    for _, end in ranges:
        end += end % 2
        if end > begin:
            out.append((begin, end))
            begin = end
    return out


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of (a, b) of which the full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = materialize(ids, "ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    texts = texts.distinct()  # all texts of a doc_id that repeats
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    total = pairs.count()
    both = salted_join(pairs, left, "a", "b", heavy_copies(pairs, "a", total))
    both = salted_join(both, right, "b", "a", heavy_copies(pairs, "b", total))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long").distinct()


def _candidates(members: DataFrame, sketches: DataFrame, least: float, forest: bool) -> DataFrame:
    spark = members.sparkSession
    dealt = members.withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    dealt = dealt.select("band", "number", "doc_id", "v", "comp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "number", "doc_id", "v", "comp", "chunk")
    dealt = dealt.join(sketches, ["doc_id", "v"]).drop("v").repartition(partitions(spark), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return dealt.mapInArrow(_blocks(least, forest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, copy_of (smallest doc_id with the same words in order), component_id.

    Linked: 100 * |intersection| >= percent * |union| of the distinct lower-cased word shingles. Other columns of
    ``docs`` are ignored.
    """
    least = percent / 100 - MARGIN
    sketches = materialize(docs.select("doc_id", "text").mapInArrow(_sketches(shingle), _SKETCH), "sketches")
    rows = sketches.count()
    copies = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("copies"))
    copies = materialize(copies, "copies")
    vertices = sketches.where("n_shingles > 0 and doc_id is not null")
    firsts = join_counted(vertices, copies, ["digest"], "copies", rows).where("doc_id = copy_of").select("doc_id", F.xxhash64("digest").alias("v"), "bands", "sketch").dropDuplicates(["doc_id", "v"])
    firsts = materialize(firsts, "firsts")
    banded = firsts.select("doc_id", "v", F.posexplode("bands").alias("number", "band"))
    shared = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "bands")
    in_bands = BANDS * rows
    members = materialize(join_counted(banded, shared, ["band"], "members", in_bands), "members")
    small = firsts.select("doc_id", "v", "sketch")
    tried = materialize(_candidates(members.withColumn("comp", F.col("doc_id")), small, least, True), "pairs")
    # texts that share a doc_id are one document
    several = vertices.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    same = vertices.join(several, "doc_id", "left_semi").join(copies, "digest").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b"))
    links = materialize(_links(docs, tried, shingle, percent).union(same), "links")
    components = materialize(connected_components(links), "components")
    named = members.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    named = materialize(named, "named")
    mixed = materialize(named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("band", "n"), "mixed")
    rest = _candidates(join_counted(named, mixed, ["band"], "n", in_bands).drop("n"), small, least, False).join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    if not rest.isEmpty():
        more = materialize(_links(docs, rest, shingle, percent), "links")
        if not more.isEmpty():
            components = connected_components(links.union(more))
    named = copies.join(components.withColumnRenamed("id", "copy_of"), "copy_of", "left").select("digest", "copies", "copy_of", F.coalesce("component", "copy_of").alias("component_id"))
    named = materialize(named, "named")
    lone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("component_id"))
    return join_counted(vertices.select("doc_id", "n_shingles", "digest"), named, ["digest"], "copies", rows).select("doc_id", "n_shingles", "copy_of", "component_id").unionByName(lone)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents of which each near-duplicate component keeps its smallest doc_id, with all their columns.

    Rows with a null doc_id stay. Of rows that repeat a doc_id that stays, one stays for each different text.
    """
    done = materialize(near_duplicates(docs, percent=percent), "near")
    drop = done.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = done.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    drop, repeated = materialize(drop, "drop"), materialize(repeated, "repeated")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = docs.join(small(drop), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(small(repeated), "doc_id", "left_anti")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    again = kept.join(small(repeated), "doc_id", "left_semi").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), row)
    return once.select(docs.columns).unionByName(again.dropDuplicates(["doc_id", "digest"]).select("row.*"))
