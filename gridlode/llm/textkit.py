"""Vectorised tokenising and n-gram hashing on Arrow/numpy buffers, shared by the Python-side operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text. A word is hashed to two keyed 64-bit
lanes, eight bytes a step with a full mix after each (words over LONG_WORD bytes by BLAKE2b), and a run of words by
mixing the hashes of its halves, so no sum or product of letters decides equality. Hashes only find
candidates: where a result depends on equal words, ``codes`` and ``exact_runs`` number words and runs by their bytes.
Memory follows the words of one call plus ``SEGMENT`` bytes of scratch, however long one text is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed in one vectorised step.
SEGMENT = 1 << 19
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_ZERO = np.zeros(1, dtype=np.int8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LONG_WORD = 256
_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_hashes(buf: bytes, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """64-bit hash of buf[start:end] for each pair."""
    seed, factor = (np.uint64(x) for x in _LANES[lane])
    chunks = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=buf + bytes(16), strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) ^ seed)
    going, at = np.flatnonzero(left <= LONG_WORD), start
    rest, place = left[going], at[going]
    while len(going):
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(0, 8 - rest) * 8).astype(np.uint64)
        out[going] = mix((out[going] ^ (chunks[place] & keep)) * factor)
        more = rest > 8
        going, rest, place = going[more], rest[more] - 8, place[more] + 8
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8, key=bytes([lane])).digest(), "little")
    return out


def run_hashes(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of n values, from the hashes of its two halves (which may overlap)."""
    factor, width = np.uint64(_LANES[lane][1] | 1), 1
    out = mix(hashes ^ np.uint64(n))
    while width < n:
        step = min(width, n - width)
        out = mix(out[:-step] * factor + out[step:])
        width += step
    return out


def exact_runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Numbers for the runs of n codes: equal numbers for equal runs only."""
    out, width = codes.astype(np.uint64), 1
    while width < n:
        step = min(width, n - width)
        out = np.unique(out[:-step] << np.uint64(32) | out[step:], return_inverse=True)[1].astype(np.uint64)
        width += step
    return out


class Words:
    """The words of a few texts: ``hash`` per word, ``doc_start`` (n_docs + 1 offsets into the words)."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, lanes: int = 1):
        buf = b" ".join(t or b"" for t in texts)
        if lower:
            buf = buf.translate(_LOWER)
        raw = np.frombuffer(buf, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        hashes, seconds, starts, ends, at = [], [], [], [], 0
        while at < len(raw):
            stop = min(len(raw), at + SEGMENT)
            if stop < len(raw):  # cut at a separator, further on if one word is longer than a segment
                seps = np.flatnonzero(_SEP[raw[at:stop]])
                while not len(seps) and stop < len(raw):
                    stop = min(len(raw), stop + SEGMENT)
                    seps = np.flatnonzero(_SEP[raw[at:stop]])
                stop = at + int(seps[-1]) + 1 if len(seps) else len(raw)
            part = raw[at:stop]
            edge = np.diff(np.concatenate([_ZERO, (~_SEP[part]).view(np.int8), _ZERO]))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            piece = buf[at:stop]
            for lane, out in zip(range(lanes), (hashes, seconds), strict=False):
                out.append(_word_hashes(piece, s, e, lane))
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.lanes = [join(h, np.uint64) for h in (hashes, seconds)[:lanes]]
        self._raw, self._start, self._end = raw, join(starts, np.int64), join(ends, np.int64)
        self.doc_start = np.searchsorted(self._start, begins)

    @property
    def hash(self) -> np.ndarray:
        return self.lanes[0]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_start)

    @property
    def codes(self) -> np.ndarray:
        """Words numbered by their bytes: equal numbers for equal words only."""
        if not len(self._start):
            return np.zeros(0, dtype=np.int64)
        data = self._raw[~_SEP[self._raw]]
        offsets = np.concatenate([[0], np.cumsum(self._end - self._start)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self._start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)

    def inside(self, n: int) -> np.ndarray:
        """First words of the runs of n words inside one text."""
        total = len(self._start)
        if total < n:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(total - n + 1)
        return at[at + n <= np.repeat(self.doc_start[1:], self.counts)[: total - n + 1]]

    def grams(self, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of n words inside one text."""
        at = self.inside(n)
        return (run_hashes(self.lanes[lane], n, lane)[at] if len(at) else np.zeros(0, dtype=np.uint64)), at


def shingles(words: Words, n: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, hash) of the distinct n-word shingles; a text of 1 to n - 1 words is one shingle.

    With ``exact`` numbers instead of hashes, equal inside this call for equal words only.
    """
    codes = words.codes if exact else None
    at = words.inside(n)
    gram = (exact_runs(codes, n)[at] if exact else run_hashes(words.hash, n)[at]) if len(at) else np.zeros(0, dtype=np.uint64)
    doc = np.searchsorted(words.doc_start, at, side="right") - 1
    counts = words.counts
    for k in range(1, n):  # a run of k words is told from longer ones by k in the upper bits
        short = np.flatnonzero(counts == k)
        if len(short):
            runs = exact_runs(codes, k) | np.uint64(k << 48) if exact else run_hashes(words.hash, k)
            gram, doc = np.concatenate([gram, runs[words.doc_start[short]]]), np.concatenate([doc, short])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])
        doc, gram = doc[new], gram[new]
    return doc, gram


def lowered(text: bytes) -> bytes:
    """With a to z for A to Z."""
    return text.translate(_LOWER)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def batches_of(texts: list[bytes | None], limit: int = SEGMENT) -> list[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes each."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= limit:
            out.append((begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def text_ranges(column: pa.ChunkedArray | pa.Array, limit: int = SEGMENT):
    """(begin, end, texts) of about ``limit`` bytes each: a batch's texts are Python objects only a range at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1
    owner = np.cumsum(sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(sizes)]])
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if end > begin:
            yield begin, end, text_bytes(column.slice(begin, end - begin))


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=dtype)
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True)
    gaps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(dtype).ravel()
    return np.cumsum(gaps, dtype=dtype)


def squeeze(values: np.ndarray) -> bytes:
    """Any integers as compressed byte planes."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=dtype)
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(dtype).ravel()
