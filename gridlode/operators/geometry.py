"""Tables from positioned words (doc_id, page_idx, word_no, x0, y0, x1, y1, text)."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import listed, map_groups

LINE_GAP, COLUMN_GAP, SLACK = 5.0, 15.0, 5.0


def grid_of(words: list[tuple[float, float, float, str]]) -> list[tuple[int, int, str]]:
    """(row, column, text) of words (x0, y0, x1, text): a line holds words within LINE_GAP of its first, a column starts
    after a horizontal gap of COLUMN_GAP, and a word belongs to the last column that starts left of it."""
    lines: list[list] = []
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        if lines and w[1] - lines[-1][0][1] <= LINE_GAP:
            lines[-1].append(w)
        else:
            lines.append([w])
    starts: list[float] = []
    for x in sorted({w[0] for w in words}):
        if not starts or x - starts[-1] > COLUMN_GAP:
            starts.append(x)
    out: dict[tuple[int, int], list[str]] = {}
    for r, line in enumerate(lines):
        for w in sorted(line):
            c = max(0, bisect_right(starts, w[0] + SLACK) - 1)
            out.setdefault((r, c), []).append(w[3])
    return [(r, c, " ".join(t)) for (r, c), t in sorted(out.items())]


def words_to_grid(words: DataFrame, region: list[str]) -> DataFrame:
    """Cells (region…, row_idx, col_idx, text); a region is small (a page or a box), and greedy line anchors need it whole."""
    return map_groups(listed(words, region, ["x0", "y0", "x1", "text"], "words"), region, ["words"], grid_of, "row_idx int, col_idx int, text string")


def weighted_columns(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12, merge: float = 8.0) -> list[float]:
    """Column centres by weighted one-dimensional k-means from quantiles; centres closer than ``merge`` become one."""
    centres = np.unique(np.quantile(x, (np.arange(min(k, 25)) + 0.5) / min(k, 25)))
    for _ in range(rounds):
        owner = np.abs(x[:, None] - centres[None, :]).argmin(axis=1)
        sums, mass = np.bincount(owner, x * weight, len(centres)), np.bincount(owner, weight, len(centres))
        new = np.sort(sums[mass > 0] / mass[mass > 0])
        if len(new) == len(centres) and np.allclose(new, centres):
            break
        centres = new
    out: list[float] = []
    for c in centres:
        if out and c - out[-1] < merge:
            out[-1] = (out[-1] + c) / 2
        else:
            out.append(float(c))
    return out


def word_weight(header: bool, bold: bool, size: float) -> float:
    return 1.0 + 1.5 * header + 1.0 * bold + 0.5 * (size > 10.5)


def rotate(words: DataFrame, angle: int, width: float, height: float) -> DataFrame:
    """Words in the frame in which a page turned by ``angle`` reads upright."""
    frames = {
        0: ("x0", "y0", "x1", "y1"), 90: ("y0", f"{width} - x1", "y1", f"{width} - x0"), 180: (f"{width} - x1", f"{height} - y1", f"{width} - x0", f"{height} - y0"), 270: (f"{height} - y1", "x0", f"{height} - y0", "x1"),
    }
    return words.withColumns({c: F.expr(e) for c, e in zip(("x0", "y0", "x1", "y1"), frames[angle % 360], strict=True)})
