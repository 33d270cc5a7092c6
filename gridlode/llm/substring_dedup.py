"""Exact removal of repeated passages with fixed-block anchors.

Let L be the window (20 words) and B = L // 2 the block. Every window holds a whole block that starts at a
multiple of B in its own text, so two equal windows share that block's B-gram:

1. index    each text's non-overlapping blocks and probe them with every rolling B-gram of every text. Both
            travel as sorted, de-duplicated 32-bit fingerprints inside a hash range, one blob for each bucket of
            texts and range. A block is an anchor if the range saw its B-gram at two places.
2. extend   back at its text, a window of which all blocks are anchors is a candidate; its 128-bit hash goes, once for
            each bucket of texts and with its first place there, to the hash's range, which tells the
            buckets which windows start earlier elsewhere and where.
3. lend     the earlier places' words are fetched, as maximal spans, from the buckets that have them. A window that
            many buckets hold is lent along a tree of FAN_OUT askers each, so no bucket serves all.
4. cut      windows are compared word by word (words are numbered by their bytes), with the lent words or inside the
            bucket. A window that starts earlier covers its words (runs of such windows are the maximal repeats);
            covered words go. Equal hashes of different words end the query with an error, so hashes decide nothing.

Nothing is capped. Buckets hold about BUCKET_BYTES of texts and ranges the fingerprints of PART_BYTES, so tasks do not grow with
the input; blobs are never more than fingerprints. A passage that many texts share is one entry of a blob
for each bucket, not one for each text, and no pairs of texts are formed. The texts are shuffled once; the
passes read the same exchange.

Defined results: a null or empty text has 0 words; texts under L words lose nothing; rows that repeat a doc_id (or have
a null one, which sorts last) are separate texts in the order in which the table is scanned.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, partitions
from .textkit import Words, batches_of, mix, pack, run_hashes, squeeze, text_bytes, unpack, unsqueeze

WINDOW = 20
#: Bytes of texts in a bucket, and of texts of which a hash range gets the fingerprints.
BUCKET_BYTES, PART_BYTES = 8 << 20, 32 << 20
#: Buckets that are lent a window's words by one other.
FAN_OUT = 16
_LAST = np.iinfo(np.int64).max

_PROBES = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("prints", pa.binary()), ("flags", pa.binary())])
_ANCHORS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("prints", pa.binary())])
_WINDOWS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("at", pa.binary())])
#: For a bucket: its late windows at (row, at) and the places (of_row, of_at) where they start earlier (other is null), or the
#: places that the buckets in ``other`` ask it for.
_LATE = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("row", pa.binary()), ("at", pa.binary()), ("of_row", pa.binary()), ("of_at", pa.binary()), ("other", pa.binary())])
#: Words lent to ``bucket``: n spans that begin at (row, at), and their words.
_LENT = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("row", pa.binary()), ("at", pa.binary()), ("words", pa.list_(pa.binary()))])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(schema).fields)


def _ordered(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, list[bytes | None]]:
    """doc_ids as given, doc_ids for comparing, row numbers, texts; in the order that 'earlier' means."""
    ids = table.column("doc_id").to_pylist()
    key = np.fromiter((_LAST if i is None else i for i in ids), dtype=np.int64, count=len(ids))
    row = table.column("row").to_numpy()
    order = np.lexsort((row, key))
    texts = text_bytes(table.column("text"))
    return [ids[i] for i in order], key[order], row[order], [texts[i] for i in order]


def _windows(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of each run of n words, over all texts, in bounded steps."""
    grams, docs, at = [], [], []
    for begin, end in batches_of(texts):
        words = Words(texts[begin:end])
        gram, pos = words.grams(n)
        doc = np.searchsorted(words.doc_start, pos, side="right") - 1
        grams.append(gram)
        docs.append(doc + begin)
        at.append(pos - words.doc_start[doc])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(grams, np.uint64), join(docs, np.int64), join(at, np.int64)


def _split(*keys: np.ndarray):
    """(begin, end) of the runs of equal keys of arrays that are sorted by them."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]]).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def _place(gram: np.ndarray, parts: int) -> np.ndarray:
    """part << 32 | fingerprint"""
    part = (gram >> np.uint64(32)) % np.uint64(parts)
    return part << np.uint64(32) | gram & np.uint64(0xFFFFFFFF)


def _probe(parts: int, block: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        gram, _, at = _windows(text_bytes(table.column("text")), block)
        place = _place(gram, parts)
        uniq, first, inverse, count = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
        flag = np.zeros(len(uniq), dtype=np.uint8)
        flag[inverse[at % block == 0]] = 1
        flag[count > 1] |= 2
        rows = {k: [] for k in _PROBES.names}
        bucket = table.column("bucket")[0].as_py()
        where = (uniq >> np.uint64(32)).astype(np.int64)
        for i, j in _split(where):
            for k, v in zip(_PROBES.names, (int(where[i]), bucket, j - i, pack((uniq[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), squeeze(flag[i:j])), strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=_PROBES)

    return run


def _anchors(table: pa.Table) -> pa.Table:
    n = np.array(table.column("n").to_pylist())
    buckets = np.repeat(np.array(table.column("bucket").to_pylist(), dtype=np.int32), n)
    prints = np.concatenate([unpack(b, k, np.uint32) for b, k in zip(table.column("prints").to_pylist(), n, strict=True)])
    flags = np.concatenate([unsqueeze(b, k, np.uint8) for b, k in zip(table.column("flags").to_pylist(), n, strict=True)])
    order = np.argsort(prints, kind="stable")
    prints, flags, buckets = prints[order], flags[order], buckets[order]
    start = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    size = np.diff(np.append(start, len(prints)))
    seen = np.bitwise_or.reduceat(flags, start)
    hot = np.repeat((seen & 1 > 0) & ((size > 1) | (seen & 2 > 0)), size)
    prints, buckets = prints[hot], buckets[hot]
    if not len(prints):
        return _ANCHORS.empty_table()
    order = np.lexsort((prints, buckets))
    prints, buckets = prints[order], buckets[order]
    begin = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    stop = np.append(begin[1:], len(buckets)).astype(int)
    part = table.column("part")[0].as_py()
    return pa.table({"bucket": buckets[begin], "part": np.full(len(begin), part, dtype=np.int32), "n": (stop - begin).astype(np.int32), "prints": [pack(prints[i:j]) for i, j in zip(begin, stop, strict=True)]}, schema=_ANCHORS)


def _extend(parts: int, block: int, window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _WINDOWS.empty_table()
        anchors = np.sort(np.concatenate([np.uint64(p) << np.uint64(32) | unpack(b, k, np.uint32).astype(np.uint64) for p, k, b in zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("prints").to_pylist(), strict=True)]))
        _, key, row, texts = _ordered(left)
        found: list[tuple] = []
        for begin, end in batches_of(texts):
            words = Words(texts[begin:end], lanes=2)
            pos = words.inside(window)
            if not len(pos):
                continue
            gram, at = words.grams(block)
            doc = np.searchsorted(words.doc_start, at, side="right") - 1
            own = (at - words.doc_start[doc]) % block == 0
            gram, at = gram[own], at[own]
            place = _place(gram, parts)
            cold = anchors[np.minimum(np.searchsorted(anchors, place), len(anchors) - 1)] != place
            miss = np.zeros(len(words.hash) + 1, dtype=np.int64)
            miss[at[cold] + 1] = 1
            miss = np.cumsum(miss)
            pos = pos[miss[pos + window - block + 1] == miss[pos]]  # all blocks that begin and end in the window are anchors
            doc = np.searchsorted(words.doc_start, pos, side="right") - 1
            found.append((run_hashes(words.lanes[0], window, 0)[pos], run_hashes(words.lanes[1], window, 1)[pos], doc + begin, pos - words.doc_start[doc]))
        if not sum(len(f[0]) for f in found):
            return _WINDOWS.empty_table()
        high, low, doc, at = (np.concatenate(c) for c in zip(*found, strict=True))
        _, first = np.unique(high, return_index=True)
        high, low, doc, at = high[first], low[first], doc[first], at[first].astype(np.int32)
        part = (high % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        high, low, doc, at, part = high[order], low[order], doc[order], at[order], part[order]
        bucket = left.column("bucket")[0].as_py()
        rows = {k: [] for k in _WINDOWS.names}
        for i, j in _split(part):
            packed = (int(part[i]), bucket, j - i, pack(high[i:j]), squeeze(low[i:j]), squeeze(key[doc[i:j]]), squeeze(row[doc[i:j]]), squeeze(at[i:j]))
            for k, v in zip(_WINDOWS.names, packed, strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=_WINDOWS)

    return run


def _column(table: pa.Table, name: str, dtype, read=unsqueeze) -> np.ndarray:
    blobs = [read(b, k, dtype) for b, k in zip(table.column(name).to_pylist(), table.column("n").to_pylist(), strict=True)]
    return np.concatenate(blobs) if blobs else np.zeros(0, dtype=dtype)


def _late(table: pa.Table) -> pa.Table:
    bucket = np.repeat(table.column("bucket").to_numpy(), table.column("n").to_numpy())
    high = _column(table, "high", np.uint64, unpack)
    low, doc, row, at = (_column(table, c, t) for c, t in (("low", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int32)))
    order = np.lexsort((doc, high))
    near = (high[order][1:] == high[order][:-1]) & ((low[order][1:] != low[order][:-1]) | (doc[order][1:] == doc[order][:-1]))
    if near.any():  # hashes that agree in one lane only, or rows that share a doc_id
        order = np.lexsort((row, doc, low, high))
    high, low, row, at, bucket = high[order], low[order], row[order], at[order], bucket[order]
    same = np.concatenate([[False], (high[1:] == high[:-1]) & (low[1:] == low[:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    late = np.flatnonzero(same)
    parent = first[late] + (late - first[late] - 1) // FAN_OUT
    rows = {k: [] for k in _LATE.names}
    for owner, asks in ((bucket[late], False), (bucket[parent], True)):
        order = np.argsort(owner, kind="stable")
        mine, theirs = late[order], parent[order]
        for i, j in _split(owner[order]):
            of = (squeeze(row[theirs[i:j]]), squeeze(at[theirs[i:j]]))
            packed = (b"", b"", *of, squeeze(bucket[mine[i:j]])) if asks else (squeeze(row[mine[i:j]]), squeeze(at[mine[i:j]]), *of, None)
            for k, v in zip(_LATE.names, (int(owner[order[i]]), j - i, *packed), strict=True):
                rows[k].append(v)
    return pa.table(rows, schema=_LATE)


def _lend(window: int):
    """Texts of a bucket and requests for its words -> the words, as maximal spans for each asker."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _LENT.empty_table()
        asker = _column(right, "other", np.int32)
        row, at = _column(right, "of_row", np.int64), _column(right, "of_at", np.int32).astype(np.int64)
        order = np.lexsort((at, row, asker))
        asker, row, at = asker[order], row[order], at[order]
        new = np.concatenate([[True], (asker[1:] != asker[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)])
        begin = np.flatnonzero(new)
        stop = at[np.append(begin[1:], len(at)) - 1] + window
        asker, row, at = asker[begin], row[begin], at[begin]
        where = {r: i for i, r in enumerate(left.column("row").to_pylist())}
        text, words, owner, split = left.column("text"), [b""] * len(row), None, []
        for k in np.argsort(row, kind="stable").tolist():  # a text is split once for all that ask for it
            if row[k] != owner:
                owner = row[k]
                split = text_bytes(text.slice(where[int(owner)], 1))[0].split()
            words[k] = b" ".join(split[at[k] : stop[k]])
        rows = {k: [] for k in _LENT.names}
        for i, j in _split(asker):
            for k, v in zip(_LENT.names, (int(asker[i]), j - i, squeeze(row[i:j]), squeeze(at[i:j].astype(np.int32)), words[i:j]), strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=_LENT)

    return run


_CONFUSED = "different words have one 128-bit hash: change the hash keys in textkit and run again"


def _equal(codes: np.ndarray, left: np.ndarray, right: np.ndarray, window: int) -> None:
    """Raises unless the windows that begin at these words are equal word by word."""
    for k in range(window):
        if not np.array_equal(codes[left + k], codes[right + k]):
            raise RuntimeError(_CONFUSED)


def _repeats(codes: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that begin at ``pos``, equal ones side by side and by place; which repeat one before; the first equal one of each."""
    if not len(pos):
        return pos, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    lanes: list[np.ndarray] = []
    for lane in (0, 1):  # one lane decides nearly always; what it confuses is told by both
        lanes.insert(0, run_hashes(mix(codes.astype(np.uint64) ^ np.uint64(lane)), window, lane)[pos])
        order = np.argsort(lanes[0], kind="stable") if not lane else np.lexsort(lanes)
        same = np.zeros(len(pos), dtype=bool)
        same[1:] = np.logical_and.reduce([h[order][1:] == h[order][:-1] for h in lanes])
        first, p = np.maximum.accumulate(np.where(same, 0, np.arange(len(pos)))), pos[order]
        if all(np.array_equal(codes[p[same] + k], codes[p[first[same]] + k]) for k in range(window)):
            return p, same, first
    raise RuntimeError(_CONFUSED)


def _cut(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        ids, _, row, texts = _ordered(left)
        given = np.asarray(right.column("words").is_valid()) if right.num_rows else np.zeros(0, dtype=bool)
        late, lent = right.filter(pa.array(~given)), right.filter(pa.array(given))
        spans = [w for group in lent.column("words").to_pylist() for w in group]
        words = Words(texts + spans, lanes=0)
        codes, starts = words.codes, words.doc_start
        pos = words.inside(window)
        p, same, first = _repeats(codes, pos[pos < starts[len(texts)]], window)
        if late.num_rows:
            by_row = np.argsort(row, kind="stable")
            mine = starts[:-1][by_row[np.searchsorted(row[by_row], _column(late, "row", np.int64))]] + _column(late, "at", np.int32)
            s_row, s_at = _column(lent, "row", np.int64), _column(lent, "at", np.int32).astype(np.int64)
            l_row, l_at = _column(late, "of_row", np.int64), _column(late, "of_at", np.int32).astype(np.int64)
            by_place = np.lexsort((s_at, s_row))  # the span of a row that begins last before the window; rows are in one bucket only
            both = np.lexsort((np.concatenate([np.zeros(len(s_at)), np.ones(len(l_at))]), np.concatenate([s_at, l_at]), np.concatenate([s_row, l_row])))
            is_span = both < len(s_at)
            span_of = np.empty(len(l_at), dtype=np.int64)
            span_of[both[~is_span] - len(s_at)] = by_place[np.cumsum(is_span)[~is_span] - 1]
            theirs = starts[len(texts) : -1][span_of] + l_at - s_at[span_of]
            _equal(codes, mine, theirs, window)
            of = np.zeros(len(codes) + 1, dtype=bool)
            of[mine] = True
            gone = same | of[p[first]]
        else:
            gone = same
        p = np.sort(p[gone])
        docs = np.searchsorted(starts, p, side="right") - 1
        at = p - starts[docs]
        cuts = np.searchsorted(docs, np.arange(len(texts) + 1))
        n_words, n_removed, removed, kept = [], [], [], []
        for k, text in enumerate(texts):
            words = (text or b"").split()
            n_words.append(len(words))
            pos = at[cuts[k] : cuts[k + 1]]
            if len(pos):
                jump = np.flatnonzero(np.diff(pos) > window)
                begin, end = pos[np.concatenate([[0], jump + 1])], pos[np.concatenate([jump, [len(pos) - 1]])] + window
                keep = np.ones(len(words), dtype=bool)
                for s, e in zip(begin, end, strict=True):
                    keep[s:e] = False
                n_removed.append(len(words) - int(keep.sum()))
                removed.append([{"start": int(s), "end": int(e)} for s, e in zip(begin, end, strict=True)])
                words = compress(words, keep.tolist())
            else:
                n_removed.append(0)
                removed.append([])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table({"doc_id": ids, "n_words": n_words, "n_removed": n_removed, "removed_spans": removed, "kept_text": kept}, schema=_RESULT)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, parts: int | None = None) -> DataFrame:
    """Per document: n_words, n_removed, removed_spans (word offsets, maximal repeats), kept_text.

    ``docs`` has doc_id and text, other columns are ignored. ``buckets`` of texts and ``parts`` of hashes follow the bytes of
    the texts; they are at least spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    if not (parts and buckets):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts, buckets = parts or max(partitions(spark), -(-size // PART_BYTES)), buckets or max(partitions(spark), -(-size // BUCKET_BYTES))
    block = window // 2
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "text", "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    by_bucket = rows.groupBy("bucket")
    probes = by_bucket.applyInArrow(_probe(parts, block, window), _ddl(_PROBES))
    anchors = probes.groupBy("part").applyInArrow(_anchors, _ddl(_ANCHORS))
    found = rows.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_extend(parts, block, window), _ddl(_WINDOWS))
    late = materialize(found.groupBy("part").applyInArrow(_late, _ddl(_LATE)), "late")
    asked = late.where("other is not null").select("bucket", "n", "of_row", "of_at", "other")
    lent = rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_lend(window), _ddl(_LENT))
    both = late.where("other is null").drop("other").withColumn("words", F.lit(None).cast("array<binary>")).unionByName(lent, allowMissingColumns=True)
    return rows.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(_cut(window), _ddl(_RESULT))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
