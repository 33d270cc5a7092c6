"""How alike two tables are: by cells, by value sets, by shape, by tree edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = (0, -1, 1, -2, 2)
ENOUGH = 0.8


def _cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The place in the batch, row, column and text of each cell of a column of arrays of (row_idx, col_idx, v)."""
    flat = column.flatten()
    owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return owner, flat.field(0).to_numpy(zero_copy_only=False).astype("int64"), flat.field(1).to_numpy(zero_copy_only=False).astype("int64"), flat.field(2).to_pylist()


def _content_scores(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """content, value_jaccard and shape of each pair of tables of a batch."""
    n = len(left)
    (oa, ra, ca, ta), (ob, rb, cb, tb) = _cells_of(left), _cells_of(right)
    codes, texts = pd.factorize(np.array([*ta, *tb, ""], dtype=object))
    empty, xa, xb = codes[-1], codes[: len(ta)], codes[len(ta) : -1]

    def size(owner, index):
        out = np.full(n, -1, dtype="int64")
        np.maximum.at(out, owner, index)
        return out + 1

    rows, cols = [(size(oa, x), size(ob, y)) for x, y in ((ra, rb), (ca, cb))]
    shape = np.minimum(*rows) / np.maximum(*rows) * np.minimum(*cols) / np.maximum(*cols)
    within = (ra < np.minimum(*rows)[oa]) & (ca < np.minimum(*cols)[oa])
    # one number for pair, row and column: rows have room for the offsets
    low, high, wide = min(ra.min(), rb.min()) - 2, max(ra.max(), rb.max()) + 3, max(ca.max(), cb.max()) + 1
    key = lambda o, r, c: (o * (high - low) + (r - low)) * wide + c
    order = np.argsort(key(ob, rb, cb), kind="stable")
    there, xb_there = key(ob, rb, cb)[order], xb[order]
    oa_in, at, xa_in = oa[within], key(oa, ra, ca)[within], xa[within]
    content, top = np.full(n, np.nan), np.full(n, np.nan)
    for offset in OFFSETS:
        first, last = np.searchsorted(there, at + offset * wide, "left"), np.searchsorted(there, at + offset * wide, "right")
        times = last - first
        owner, a = np.repeat(oa_in, times), np.repeat(xa_in, times)
        b = xb_there[np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(a))]
        value = ((a == b) & (a != empty)).astype(float)
        other = np.flatnonzero((a != b) & (a != empty) & (b != empty))
        value[other] = [0.5 if x in y or y in x else 0.0 for x, y in zip(texts[a[other]], texts[b[other]], strict=True)]
        met = np.bincount(owner, minlength=n)
        score = np.divide(np.bincount(owner, value, n), met, out=np.full(n, np.nan), where=met > 0)
        content = np.where(np.isnan(content) & (score >= ENOUGH), score, content)
        top = np.fmax(top, score)
    content = np.where(np.isnan(content), top, content)
    seen = lambda o, x: np.unique((o * len(texts) + x)[x != empty])
    sa, sb = seen(oa, xa), seen(ob, xb)
    both = np.bincount(np.intersect1d(sa, sb, assume_unique=True) // len(texts), minlength=n)
    union = np.bincount(sa // len(texts), minlength=n) + np.bincount(sb // len(texts), minlength=n) - both
    return np.nan_to_num(content), np.divide(both, union, out=np.zeros(n), where=union > 0), shape


def content_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, content, value_jaccard, shape) for pairs (pair_id, a_id, b_id) of tables of cells (id, row_idx, col_idx, text).

    Cells match at one of five row offsets: 1 if equal, a half if one contains the other, both empty count as nothing. The
    first offset with ENOUGH wins, otherwise the best. A table's cells are one array, so each side is shuffled once by
    its id, and no offset has rows of its own; the cells of a batch of pairs meet by sorted keys.
    """
    clean = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    cells = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), "row_idx", "col_idx", clean.alias("v")).groupBy(f"{s}_id").agg(F.collect_list(F.struct("row_idx", "col_idx", "v")).alias(s))
    both = pairs.join(cells(left, "a"), "a_id").join(cells(right, "b"), "b_id").select("pair_id", "a", "b")

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                scores = [pa.array(x, pa.float64()) for x in _content_scores(batch.column(1), batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *scores], names=["pair_id", "content", "value_jaccard", "shape"])

    return both.mapInArrow(score, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, content double, value_jaccard double, shape double")


def combined(scores: DataFrame, tree: str | None = None) -> DataFrame:
    """Adds similarity: nothing in common is 0; with a tree score .30 tree + .40 content + .15 values + .15 shape, else .55 / .25 / .20."""
    c, j, s = F.col("content"), F.col("value_jaccard"), F.col("shape")
    mixed = 0.30 * F.col(tree) + 0.40 * c + 0.15 * j + 0.15 * s if tree else 0.20 * s + 0.55 * c + 0.25 * j
    return scores.withColumn("similarity", F.when((c < 0.10) & (j < 0.10), 0.0).otherwise(mixed))


def semantic_equivalence(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, column_jaccard, value_jaccard, equivalent): .4 and .6 of the two, at least 0.85. Sides are (id, columns, values) arrays."""
    both = pairs.join(left.select(F.col("id").alias("a_id"), F.col("columns").alias("ca"), F.col("values").alias("va")), "a_id").join(right.select(F.col("id").alias("b_id"), F.col("columns").alias("cb"), F.col("values").alias("vb")), "b_id")
    j = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    out = both.select("pair_id", j("ca", "cb").alias("column_jaccard"), j("va", "vb").alias("value_jaccard"))
    return out.withColumn("equivalent", 0.4 * F.col("column_jaccard") + 0.6 * F.col("value_jaccard") >= 0.85)


def _levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tree_of(header: list[str] | None, rows: list[list[str]]) -> list[tuple[str, str, int]]:
    """A table as (tag, text, size of subtree) in post-order: cells, their row, the table."""
    out: list[tuple[str, str, int]] = []
    for tag, cells in [*([("th", header)] if header else []), *[("td", r) for r in rows]]:
        out += [(tag, (c or "").strip(), 1) for c in cells]
        out.append(("tr", "", len(cells) + 1))
    out.append(("table", "", len(out) + 1))
    return out


def tree_distance(a: list[tuple[str, str, int]], b: list[tuple[str, str, int]], structure_only: bool = False) -> float:
    """Ordered tree edit distance: 1 for insert, delete and another tag; the normalised edit distance of texts for two cells."""
    n, m = len(a), len(b)
    left_a, left_b = [i - a[i][2] + 1 for i in range(n)], [j - b[j][2] + 1 for j in range(m)]
    roots = lambda left: sorted({first: k for k, first in enumerate(left)}.values())  # noqa: E731  the last node with a leftmost leaf
    texts: dict[tuple[str, str], float] = {}

    def change(x, y) -> float:
        if x[0] != y[0]:
            return 1.0
        if structure_only or x[0] not in ("td", "th") or x[1] == y[1]:
            return 0.0
        key = (x[1], y[1])
        if key not in texts:
            texts[key] = _levenshtein(*key) / max(len(x[1]), len(y[1]))
        return texts[key]

    whole = [[0.0] * m for _ in range(n)]
    for i in roots(left_a):
        for j in roots(left_b):
            p, q = left_a[i], left_b[j]
            grid = [[float(x + y) if not x or not y else 0.0 for y in range(j - q + 2)] for x in range(i - p + 2)]
            for x in range(p, i + 1):
                row, above = grid[x - p + 1], grid[x - p]
                for y in range(q, j + 1):
                    edit = min(above[y - q + 1], row[y - q]) + 1.0
                    if left_a[x] == p and left_b[y] == q:
                        row[y - q + 1] = whole[x][y] = min(edit, above[y - q] + change(a[x], b[y]))
                    else:
                        row[y - q + 1] = min(edit, grid[left_a[x] - p][left_b[y] - q] + whole[x][y])
    return whole[n - 1][m - 1]


def tree_similarity(a: list[tuple[str, str, int]], b: list[tuple[str, str, int]], structure_only: bool = False) -> float:
    if len(a) <= 1 and len(b) <= 1:
        return 1.0
    if len(a) <= 1 or len(b) <= 1:
        return 0.0
    if a == b:
        return 1.0
    return max(0.0, 1.0 - tree_distance(a, b, structure_only) / max(len(a), len(b)))


def sample(rows: list, most: int) -> list:
    """Head and tail of what is longer than ``most``."""
    return rows if len(rows) <= most else rows[: most // 2] + rows[len(rows) - (most - most // 2) :]


# Fixed sizes: pairs of texts compared at once, longest texts compared as arrays, fewest pairs of one form that go together.
TEXT_PAIRS, LONGEST, TOGETHER = 2_000_000, 64, 4


def _levenshtein_many(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distances of texts[a] and texts[b]: pairs of equal lengths go through the rows of their table together."""
    lengths = np.array([len(x) for x in texts], dtype="int64")
    out = np.zeros(len(a), dtype="int64")
    la, lb = lengths[a], lengths[b]
    empty, far = (la == 0) | (lb == 0), (la > LONGEST) | (lb > LONGEST)
    out[empty] = np.maximum(la, lb)[empty]
    known: dict[tuple[int, int], int] = {}
    for at in np.flatnonzero(far & ~empty):
        key = (a[at], b[at])
        if key not in known:
            known[key] = _levenshtein(texts[key[0]], texts[key[1]])
        out[at] = known[key]
    short = np.flatnonzero(~empty & ~far)
    if not len(short):
        return out
    letters = np.zeros((LONGEST, len(texts)), dtype="uint32")
    for k in range(1, LONGEST + 1):
        same = np.flatnonzero(lengths == k)
        if len(same):
            letters[:k, same] = np.array([texts[i] for i in same], dtype=f"U{k}").view("uint32").reshape(-1, k).T
    form = la[short] * (LONGEST + 1) + lb[short]
    order = np.argsort(form, kind="stable")
    short, form = short[order], form[order]
    for at in np.split(short, np.flatnonzero(np.diff(form)) + 1):
        for k in range(0, len(at), 65_536):
            part = at[k : k + 65_536]
            n, m = int(la[part[0]]), int(lb[part[0]])
            x, y = letters[:n, a[part]], letters[:m, b[part]]
            row = [np.full(len(part), j, dtype="int8") for j in range(m + 1)]
            for i in range(n):
                last, row[0] = row[0], np.full(len(part), i + 1, dtype="int8")
                for j in range(1, m + 1):
                    best = np.minimum(row[j], row[j - 1])
                    best += 1
                    np.minimum(best, last + (x[i] != y[j - 1]), out=best)
                    last, row[j] = row[j], best
            out[part] = row[m]
    return out


def _form_of(form: tuple) -> tuple[list[str], list[int], list[int], list[int]]:
    """Tags, leftmost leaves, last nodes of each leftmost leaf and leaves of a tree of (cells of the header, cells of each row)."""
    tree = tree_of([""] * form[0] if form[0] else None, [[""] * k for k in form[1:]])
    left = [k - size + 1 for k, (_, _, size) in enumerate(tree)]
    return [tag for tag, _, _ in tree], left, sorted({first: k for k, first in enumerate(left)}.values()), [k for k, (tag, _, _) in enumerate(tree) if tag in ("td", "th")]


def _tree_distances(form_a: tuple, form_b: tuple, change: np.ndarray) -> np.ndarray:
    """``tree_distance`` of many pairs of trees of two forms; change is (cells of a, cells of b, pairs)."""
    (tags_a, left_a, roots_a, leaves_a), (tags_b, left_b, roots_b, leaves_b) = _form_of(form_a), _form_of(form_b)
    n, m, size = len(tags_a), len(tags_b), change.shape[2]
    whole = np.zeros((n, m, size))
    whole[np.ix_(leaves_a, leaves_b)] = change
    bare_a, bare_b = set(leaves_a), set(leaves_b)
    for i in roots_a:
        for j in roots_b:
            if i in bare_a and j in bare_b:
                continue  # two cells: the change itself
            p, q = left_a[i], left_b[j]
            grid = np.zeros((i - p + 2, j - q + 2, size))
            grid[:, 0], grid[0] = np.arange(i - p + 2)[:, None], np.arange(j - q + 2)[:, None]
            for x in range(p, i + 1):
                row, above = grid[x - p + 1], grid[x - p]
                for y in range(q, j + 1):
                    best = row[y - q + 1]
                    np.minimum(above[y - q + 1], row[y - q], out=best)
                    best += 1.0
                    if left_a[x] == p and left_b[y] == q:
                        one = whole[x, y] if x in bare_a and y in bare_b else float(tags_a[x] != tags_b[y])
                        whole[x, y] = np.minimum(best, above[y - q] + one, out=best)
                    else:
                        np.minimum(best, grid[left_a[x] - p, left_b[y] - q] + whole[x, y], out=best)
    return whole[n - 1, m - 1]


def _tree_scores_of(tables: list[tuple]) -> list[float]:
    """``tree_similarity`` of (header, rows, header, rows): pairs of one form share the rows of one table of distances."""
    clean = lambda cells: [(c or "").strip() for c in cells]
    scores = [0.0] * len(tables)
    forms: dict[tuple, list[tuple[int, list[str], list[str]]]] = {}
    for at, (ha, ra, hb, rb) in enumerate(tables):
        form_a, form_b = (len(ha or []), *map(len, ra)), (len(hb or []), *map(len, rb))
        if form_a == (0,) or form_b == (0,):
            scores[at] = float(form_a == form_b)
            continue
        forms.setdefault((form_a, form_b), []).append((at, clean([c for r in [ha or [], *ra] for c in r]), clean([c for r in [hb or [], *rb] for c in r])))
    for (form_a, form_b), members in forms.items():
        nodes = max(sum(f) + len(f) - (f[0] == 0) + 1 for f in (form_a, form_b))
        head_a, head_b, wide_a, wide_b = form_a[0], form_b[0], sum(form_a), sum(form_b)
        if len(members) < TOGETHER or not wide_a or not wide_b:
            for at, _, _ in members:
                ha, ra, hb, rb = tables[at]
                scores[at] = tree_similarity(tree_of(ha, ra), tree_of(hb, rb))
            continue
        most = max(1, TEXT_PAIRS // (wide_a * wide_b))
        for k in range(0, len(members), most):
            part = members[k : k + most]
            codes, texts = pd.factorize(np.array([c for _, a, b in part for c in (*a, *b)], dtype=object))
            codes = codes.reshape(len(part), wide_a + wide_b)
            a = np.broadcast_to(codes[:, :wide_a].T[:, None, :], (wide_a, wide_b, len(part)))
            b = np.broadcast_to(codes[:, wide_a:].T[None, :, :], (wide_a, wide_b, len(part)))
            change = np.zeros(a.shape)
            other = a != b
            length = np.array([len(x) for x in texts])
            change[other] = _levenshtein_many(list(texts), a[other], b[other]) / np.maximum(length[a[other]], length[b[other]])
            change[:head_a, head_b:], change[head_a:, :head_b] = 1.0, 1.0  # a name and a cell
            distances = _tree_distances(form_a, form_b, change)
            for (at, _, _), d in zip(part, distances.tolist(), strict=True):
                scores[at] = max(0.0, 1.0 - d / nodes)
    return scores


def tree_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, max_rows: int = 15, max_cols: int = 10) -> DataFrame:
    """(pair_id, tree) of tables (id, header array, rows array of arrays); tables are sampled to a bounded size as trees.

    Edit distances are computed for many pairs at once: those of a batch whose tables have the same form.
    """
    both = pairs.join(left.select(F.col("id").alias("a_id"), F.col("header").alias("ha"), F.col("rows").alias("ra")), "a_id").join(right.select(F.col("id").alias("b_id"), F.col("header").alias("hb"), F.col("rows").alias("rb")), "b_id")

    def cut(header, rows):
        return sample(header, max_cols) if header is not None else None, [sample(r, max_cols) for r in sample(rows, max_rows)]

    def score(batches):
        for batch in batches:
            tables = [(*cut(ha, ra), *cut(hb, rb)) for ha, ra, hb, rb in zip(*[batch.column(c).to_pylist() for c in ("ha", "ra", "hb", "rb")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(_tree_scores_of(tables), pa.float64())], names=["pair_id", "tree"])

    return both.select("pair_id", "ha", "ra", "hb", "rb").mapInArrow(score, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, tree double")
