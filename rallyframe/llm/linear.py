"""Linear models on hashed n-gram indicators, fitted by dual coordinate descent.

Fitting takes a bounded sample of labelled rows (the bound is a parameter of each operator), so it
runs in one process; scoring runs in Spark tasks over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rallyframe.llm.text import U64, WORD, doc_of, mix, slices, span_hashes, spans

BITS = 18
DIM = 1 << BITS


def ngram_ids(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...], pairs: bool) -> np.ndarray:
    """Distinct (document << BITS | feature) codes of the documents of one slice, sorted.

    Tokens are runs of letters, digits and non-ASCII bytes, and runs of other visible bytes. The
    features are the tokens, their initial parts of the given lengths and, with ``pairs``, pairs of
    neighbours (a pair of equal neighbours has a feature of its own).
    """
    word, blank = WORD[data], data <= 32
    kinds = [spans(word, offsets), spans(~word & ~blank, offsets)]
    starts = np.concatenate([k[0] for k in kinds])
    ends = np.concatenate([k[1] for k in kinds])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return np.zeros(0, np.int64)
    docs = doc_of(starts, offsets)
    h = span_hashes(data, starts, ends)
    codes, owners = [h], [docs]
    for n in prefixes:
        long = ends - starts > n
        codes.append(mix(span_hashes(data, starts[long], starts[long] + n) ^ U64(n)))
        owners.append(docs[long])
    if pairs and len(h) > 1:
        same_doc = docs[1:] == docs[:-1]
        two = np.where(h[1:] == h[:-1], U64(12345), mix(h[:-1] * U64(3) + h[1:]))
        codes.append(two[same_doc])
        owners.append(docs[1:][same_doc])
    code = (np.concatenate(owners) << BITS) | (np.concatenate(codes) >> U64(64 - BITS)).astype(np.int64)
    code.sort()
    return code[np.append(True, code[1:] != code[:-1])]


def features(column: pa.Array, prefixes: tuple[int, ...] = (), pairs: bool = False):
    """(first row, last row + 1, row of each feature, feature) by slices of a column of texts."""
    for lo, hi, data, offsets in slices(column):
        code = ngram_ids(data, offsets, prefixes, pairs)
        yield lo, hi, code >> BITS, code & (DIM - 1)


def feature_lists(owner: np.ndarray, feature: np.ndarray, n: int) -> pa.Array:
    """The features of each of ``n`` rows as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(feature.astype(np.int32)))


def training_rows(got: pa.Table, marks: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Marks and features of the sampled rows in an order that depends on nothing but the rows."""
    y = np.array(got.column(marks).to_pylist(), int)
    y = y.reshape(len(y), -1) if len(y) else np.zeros((0, 1), int)
    rows = [np.asarray(x.values, np.int64) for x in got.column("features")]
    order = sorted(range(len(y)), key=lambda i: (y[i].tolist(), len(rows[i]), rows[i].tobytes()))
    return y[order], [rows[i] for i in order]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each feature the logarithm of its share among the positive rows' features over that among the negative ones', counts raised by 1."""
    counts = [np.bincount(np.concatenate([r for r, mine in zip(rows, y > 0) if mine == side] or [np.zeros(0, int)]).astype(int), minlength=DIM) + 1.0 for side in (True, False)]
    return np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))


def hinge_dcd(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int):
    """L2-regularised hinge loss by dual coordinate descent.

    Row i has the features ``rows[i]`` with values ``scale[feature]``, divided by the row's norm,
    followed by the dense values ``extra[i]``. The classes' costs are balanced. Returns the weights
    of the features (times ``scale``) and of the dense values.
    """
    w, v = np.zeros(len(scale)), np.zeros(extra.shape[1])
    values = []
    for r in rows:
        x = scale[r]
        values.append(x / max(np.sqrt((x * x).sum()), 1e-9))
    norms = np.array([(x * x).sum() for x in values]) + (extra * extra).sum(1) + 1e-12
    share = max(1e-6, (y > 0).mean())
    most = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-6, 1 - share))
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r, x = rows[i], values[i]
            gap = y[i] * (w[r] @ x + v @ extra[i]) - 1
            new = min(max(alpha[i] - gap / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                v += step * extra[i]
                alpha[i] = new
    return w, v


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (Newton steps)."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
        if abs(d).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Linear:
    """Weights of hashed features (float32, DIM long), of dense values, and the calibration."""

    weights: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    slope: float
    offset: float

    def margins(self, owner: np.ndarray, feature: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        squares = np.bincount(owner, weights=self.scale[feature] ** 2, minlength=n)
        dots = np.bincount(owner, weights=self.weights[feature], minlength=n)
        return dots / np.maximum(np.sqrt(squares), 1e-9) + extra @ self.dense

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, cost: float, epochs: int = 12, folds: int = 3, beta: float = 1.0):
    """A calibrated model, and the out-of-fold probabilities of its own training rows.

    The values of the features are the classes' log-count ratios, learned on the training part of
    each fold. The calibration uses out-of-fold margins. With one class only,
    the probability is that class's, whatever the features.
    """
    y = np.where(y > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        p = 40.0 if len(y) and y[0] > 0 else -40.0
        none = np.zeros(DIM, np.float32)
        return Linear(none, none, np.zeros(extra.shape[1]), 0.0, p), np.full(len(y), float(p > 0))

    def train(keep: np.ndarray, seed: int):
        mine = [rows[i] for i in keep]
        scale = log_count_ratios(mine, y[keep])
        w, v = hinge_dcd(mine, extra[keep], y[keep], scale, cost, epochs, seed)
        if beta < 1:
            w = beta * w + (1 - beta) * np.abs(w).mean()
        return w * scale, scale, v

    def margin(model, i):
        w, scale, v = model
        r = rows[i]
        return w[r].sum() / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) + extra[i] @ v

    part = np.random.default_rng(7).permutation(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        keep = np.flatnonzero(part != k)
        if (y[keep] > 0).all() or (y[keep] < 0).all():
            continue
        model = train(keep, k)
        for i in np.flatnonzero(part == k):
            held[i] = margin(model, i)
    slope, offset = platt(held, y)
    w, scale, v = train(np.arange(len(y)), folds)
    found = Linear(w.astype(np.float32), scale.astype(np.float32), v, slope, offset)
    return found, found.probability(held)
