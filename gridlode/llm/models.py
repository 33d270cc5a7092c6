"""Small models that are fitted on the driver on bounded samples and applied in batches: numpy only."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """L2 logistic regression by Newton steps on standardised columns."""

    def __init__(self, l2: float = 1.0, steps: int = 25):
        self.l2, self.steps = l2, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.begin(*(x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1])))
        z = self._design(x)
        for _ in range(self.steps):
            if self.step(*self.sums(z, y, weight)) < 1e-6:
                break
        return self

    def begin(self, mean: np.ndarray, scale: np.ndarray) -> Logistic:
        self.mean, self.scale, self.coef = mean, scale, np.zeros(len(mean) + 1)
        return self

    def sums(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss over rows of the design; those of parts of the rows add up."""
        p = sigmoid(z @ self.coef)
        return z.T @ (weight * (p - y)), (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z

    def loss(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        logit = z @ self.coef
        return float((weight * (np.logaddexp(0, logit) - y * logit)).sum())

    def _ridge(self) -> np.ndarray:
        return np.concatenate([[1e-6], np.full(len(self.coef) - 1, self.l2)])

    def step(self, slope: np.ndarray, curve: np.ndarray) -> float:
        """A Newton step by the sums over all rows; how far the coefficients were to move."""
        ridge = self._ridge()
        move = np.linalg.solve(curve + np.diag(ridge), slope + ridge * self.coef)
        self.coef = self.coef - move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        return float(np.abs(move).max())

    def guarded_step(self, loss: float, slope: np.ndarray, curve: np.ndarray, best: list) -> float:
        """``step``, but where the last one made the loss larger, half of it instead. ``best``: loss and coefficients of the best step so far, empty at first."""
        total = loss + float((self._ridge() * self.coef**2).sum()) / 2
        if best and total > best[0] + 1e-9 * abs(best[0]):
            moved = self.coef - best[1]
            self.coef = best[1] + moved / 2
            return float(np.abs(moved).max())
        best[:] = [total, self.coef]
        return self.step(slope, curve)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.coef


class BoostedTrees:
    """Gradient-boosted regression trees for log loss, with histograms of at most ``bins`` values a column."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.forest = float(np.log(share / (1 - share))), []
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        if len(np.unique(y)) < 2:
            return self
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = sigmoid(score)
            tree = self._grow(binned, y - p, p * (1 - p) + 1e-6, np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, binned, slope, curve, rows, depth):
        total_s, total_c = slope[rows].sum(), curve[rows].sum()
        leaf = {"value": self.rate * total_s / (total_c + self.l2)}
        if not depth or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for k, e in enumerate(self.edges):
            if not len(e):
                continue
            b = binned[rows, k]
            n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            s = np.cumsum(np.bincount(b, slope[rows], minlength=len(e) + 1))[:-1]
            c = np.cumsum(np.bincount(b, curve[rows], minlength=len(e) + 1))[:-1]
            gain = s**2 / (c + self.l2) + (total_s - s) ** 2 / (total_c - c + self.l2) - total_s**2 / (total_c + self.l2)
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        if best[1] is None:
            return leaf
        left = binned[rows, best[1]] <= best[2]
        return {
            "column": best[1], "at": float(self.edges[best[1]][best[2]]),
            "left": self._grow(binned, slope, curve, rows[left], depth - 1), "right": self._grow(binned, slope, curve, rows[~left], depth - 1),
        }

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if "value" in tree:
            return np.full(len(x), tree["value"])
        left = x[:, tree["column"]] <= tree["at"]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree["left"], x[left]), self._walk(tree["right"], x[~left])
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.forest:
            out += self._walk(tree, x)
        return out


class Isotonic:
    """Pool-adjacent-violators: a rising step function, straight between the middles of its steps."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, sum of score
        for s, t in zip(score[order], y[order], strict=True):
            blocks.append([float(t), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.zeros(len(score))
