"""Gradient-boosted trees that grow leaf by leaf over binned features, for binary labels.

Spark's own boosting grows level by level, has no limit of leaves and no patience, so it
cannot follow the schedule that the linkage task prescribes. The fit takes a bounded number of rows (the caller
sees to that) and runs on the driver; scoring is an Arrow function over any number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 255


@dataclass
class Schedule:
    """rounds at most; patience: rounds without a better loss or a better AUC on the validation rows after which to stop."""

    rounds: int = 500
    patience: int = 50
    rate: float = 0.05
    leaves: int = 31
    depth: int = 6
    least_rows: int = 20
    least_hessian: float = 1e-3
    columns: float = 0.8
    seed: int = 42


@dataclass
class Trees:
    """Each tree's nodes: the feature (-1 at a leaf) and threshold, children, the leaf's value, and the gain of the split."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.feature)

    def cut(self, rounds: int) -> Trees:
        return Trees(self.base, *[x[:rounds] for x in (self.feature, self.threshold, self.left, self.right, self.value, self.gain)])

    def _padded(self) -> list[np.ndarray]:
        most = max(len(f) for f in self.feature)
        pad = lambda arrays, fill: np.stack([np.concatenate([a, np.full(most - len(a), fill, a.dtype)]) for a in arrays])
        return [pad(self.feature, -1), pad(self.threshold, 0.0), pad(self.left, 0), pad(self.right, 0), pad(self.value, 0.0)]

    def margins(self, x: np.ndarray, chunk: int = 100_000) -> np.ndarray:
        """The sum of the trees' leaves for each row of x."""
        out = np.full(len(x), self.base)
        if not len(self) or not len(x):
            return out
        feature, threshold, left, right, value = self._padded()
        tree = np.arange(len(self))[None]
        rows = max(1, chunk // len(self))
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            node = np.zeros((len(part), len(self)), np.int64)
            while True:
                f = feature[tree, node]
                inner = f >= 0
                if not inner.any():
                    break
                low = np.take_along_axis(part, np.maximum(f, 0), 1) <= threshold[tree, node]
                node = np.where(inner, np.where(low, left[tree, node], right[tree, node]), node)
            out[a : a + rows] += value[tree, node].sum(1)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def _edges(values: np.ndarray) -> np.ndarray:
    """Thresholds between distinct values, at most BINS - 1 of them, about equally many rows between them."""
    distinct = np.unique(values)
    if len(distinct) > BINS:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="lower"))
    return (distinct[1:] + distinct[:-1]) / 2


def log_loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin)) if len(y) else 0.0


def auc(margin: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a positive and a negative in the right order, ties being half; 1 if there are none."""
    pos, neg = margin[y == 1], margin[y == 0]
    if not len(pos) or not len(neg):
        return 1.0
    sorted_ = np.sort(neg)
    below, upto = np.searchsorted(sorted_, pos), np.searchsorted(sorted_, pos, "right")
    return float((below + upto).sum() / (2 * len(pos) * len(neg)))


class _Grower:
    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], plan: Schedule):
        self.bins, self.edges, self.plan = bins, edges, plan
        self.flat = bins.astype(np.int32) + (np.arange(bins.shape[1], dtype=np.int32) * (BINS + 1))
        self.last = np.array([len(e) for e in edges])  # the last bin of each feature

    def histogram(self, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """[sum of gradients, of hessians, rows; feature; bin]."""
        n = self.bins.shape[1]
        flat = self.flat[rows].ravel()
        sums = [np.bincount(flat, weights=None if w is None else np.repeat(w[rows], n), minlength=n * (BINS + 1)) for w in (gradient, hessian, None)]
        return np.stack(sums).reshape(3, n, BINS + 1).astype(np.float64)

    def best(self, sums: np.ndarray, used: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin) of the best split: rows up to the bin go left; the first of equals."""
        low = np.cumsum(sums, 2)
        total = low[:, :, -1:]
        high = total - low
        plan = self.plan
        ok = (low[2] >= plan.least_rows) & (high[2] >= plan.least_rows) & (low[1] >= plan.least_hessian) & (high[1] >= plan.least_hessian)
        ok &= used[:, None] & (np.arange(BINS + 1)[None] < self.last[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low[0] ** 2 / low[1] + high[0] ** 2 / high[1] - total[0] ** 2 / total[1]
        gain = np.where(ok, gain, -np.inf)
        at = int(gain.argmax())
        return float(gain.flat[at]), at // (BINS + 1), at % (BINS + 1)

    def tree(self, gradient: np.ndarray, hessian: np.ndarray, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The arrays of a tree, and the leaf value of each row."""
        plan, rows = self.plan, np.arange(len(self.bins))
        nodes = [[-1, 0.0, 0, 0, 0.0, 0.0]]
        sums = self.histogram(rows, gradient, hessian)
        open_ = {0: (rows, sums, 0, self.best(sums, used))}
        done: dict[int, np.ndarray] = {}
        while open_ and len(open_) + len(done) < plan.leaves:
            at = max(open_, key=lambda i: (open_[i][3][0], -i))
            rows, sums, depth, (gain, f, b) = open_.pop(at)
            if gain <= 0 or depth >= plan.depth:
                done[at] = rows
                if all(x[3][0] <= 0 or x[2] >= plan.depth for x in open_.values()):
                    break
                continue
            low = self.bins[rows, f] <= b
            parts = rows[low], rows[~low]
            small = 0 if len(parts[0]) <= len(parts[1]) else 1
            own = self.histogram(parts[small], gradient, hessian)
            both = (own, sums - own) if small == 0 else (sums - own, own)
            first = len(nodes)
            nodes[at] = [f, float(self.edges[f][b]), first, first + 1, 0.0, gain]
            for i in range(2):
                nodes.append([-1, 0.0, 0, 0, 0.0, 0.0])
                open_[first + i] = (parts[i], both[i], depth + 1, self.best(both[i], used))
        change = np.zeros(len(self.bins))
        for at, rows in [*done.items(), *((i, x[0]) for i, x in open_.items())]:
            nodes[at][4] = change[rows] = -plan.rate * gradient[rows].sum() / max(1e-12, hessian[rows].sum())
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64, np.float64)
        return [np.array([x[i] for x in nodes], k) for i, k in enumerate(kinds)], change


def fit(x: np.ndarray, y: np.ndarray, x_valid: np.ndarray | None = None, y_valid: np.ndarray | None = None, plan: Schedule | None = None) -> Trees:
    """Trees for x and y (0 or 1), positives weighing as much as negatives; cut at the best round by the validation rows, if there are any."""
    plan = plan or Schedule()
    positives, n = float(y.sum()), len(y)
    weight = np.where(y == 1, (n - positives) / max(positives, 1.0), 1.0)
    share = float((weight * y).sum() / weight.sum()) if weight.sum() > 0 else 0.5
    out = Trees(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))))
    if not positives or positives == n:
        out.base = 13.8 if n and positives == n else -13.8
        return out
    edges = [_edges(x[:, i]) for i in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
    grower, draw = _Grower(bins, edges, plan), np.random.default_rng(plan.seed)
    margin, judged = np.full(n, out.base), x_valid is not None and len(x_valid) > 0
    valid = np.full(len(x_valid), out.base) if judged else np.zeros(0)
    best = {"loss": (np.inf, 0), "auc": (np.inf, 0)}
    columns = max(1, round(plan.columns * x.shape[1]))
    for round_ in range(1, plan.rounds + 1):
        p = 1 / (1 + np.exp(-margin))
        used = np.zeros(x.shape[1], bool)
        used[draw.choice(x.shape[1], columns, replace=False)] = True
        arrays, change = grower.tree((p - y) * weight, p * (1 - p) * weight, used)
        for mine, new in zip((out.feature, out.threshold, out.left, out.right, out.value, out.gain), arrays, strict=True):
            mine.append(new)
        margin = margin + change
        if not judged:
            continue
        valid = valid + Trees(0.0, *[[a] for a in arrays]).margins(x_valid)
        for name, now in (("loss", log_loss(valid, y_valid)), ("auc", -auc(valid, y_valid))):
            if now < best[name][0]:
                best[name] = (now, round_)
        spent = [at for _, at in best.values() if round_ - at >= plan.patience]
        if spent:
            return out.cut(spent[0])
    return out.cut(best["loss"][1]) if judged else out
