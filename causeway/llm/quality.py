"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word
repetition and length, of the line itself and of the lines before and after;
the chain's transitions tie neighbours further. Forward-backward marginals of
"good", weighted by line length, make up the document's quality, which a
logistic curve fitted on the training documents turns into a score.

Labels are per document, so lines are labelled in turns: at first all lines of a
bad document are bad, then those that the last fit finds bad, but always its
worst one; lines of good documents stay good. The model is fitted on at most
``SAMPLE`` documents that are not held out, all their lines; scoring reads whole
texts.

Defined results: null and empty texts are one empty line; repeated rows get
equal scores; null labels are not learnt from; without labels of both kinds
every document scores 0.5; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of
from .labelled import held_out, training_sample

#: Labelled documents that are learnt from at most.
SAMPLE = 6000
ROUNDS, STEPS, RATE, L2 = 3, 120, 0.15, 1e-3
#: Longer training sequences are cut into pieces of this many lines.
PIECE = 64
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASSES[_c] = 1 if "A" <= _s <= "Z" else 2 if "a" <= _s <= "z" else 3 if _s.isdigit() and _c < 128 else 4 if _s in " \t\r" else 5 if _s in ".,;:'\"?-()" else 6 if _c < 128 else 0
N_OWN = 13


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, weight of each line) of a text."""
    lines = (text or "").split("\n")
    raw = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in raw])
    sizes = np.diff(ends, prepend=0)
    classes = _CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    row = np.repeat(np.arange(len(raw)), sizes)
    counts = np.bincount(row * 8 + classes, minlength=8 * len(raw)).reshape(-1, 8)[:, :7]
    n = np.maximum(sizes, 1)[:, None]
    out = np.zeros((len(raw), N_OWN))
    out[:, :7] = counts / n
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 2], 1)
    out[:, 7] = counts[:, 1] / letters
    for i, x in enumerate(raw):
        w = x.split()
        k = len(w)
        if k > 1:
            out[i, 8] = 1 - len(set(w)) / k
            out[i, 9] = sum(map(bytes.__eq__, w, w[1:])) / (k - 1)
            out[i, 10] = min((len(x) - k + 1) / k / 10, 3)
        out[i, 11] = min(k / 30, 3)
    out[:, 12] = np.log1p(sizes) / 8
    return out, sizes + 1.0


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Adds the features of the lines before and after, and a constant."""
    edge = np.zeros((1, own.shape[1]))
    return np.concatenate((own, np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge)), np.ones((len(own), 1))), axis=1)


def marginals(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(good) of every line: ``scores`` favour good over bad, in logits."""
    n = len(scores)
    if n == 1:
        return 1 / (1 + np.exp(-scores))
    t00, t01, t10, t11 = np.exp(transitions - transitions.max()).ravel().tolist()
    good = (1 / (1 + np.exp(-scores))).tolist()
    ahead, a, b = [0.0] * n, 1 - good[0], good[0]
    ahead[0] = (a, b)
    for i in range(1, n):
        g = good[i]
        x, y = (a * t00 + b * t10) * (1 - g), (a * t01 + b * t11) * g
        s = x + y
        a, b = x / s, y / s
        ahead[i] = (a, b)
    out, a, b = [0.0] * n, 1.0, 1.0
    for i in range(n - 1, -1, -1):
        p, q = ahead[i]
        x, y = p * a, q * b
        out[i] = y / (x + y)
        g = good[i]
        x, y = (1 - g) * a, g * b
        a, b = t00 * x + t01 * y, t10 * x + t11 * y
        s = a + b
        a, b = a / s, b / s
    return np.array(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(P(good), weight) of every line."""
        own, weight = line_features(text)
        return marginals(np.clip(with_neighbours(own) @ self.weights, -30, 30), self.transitions), weight

    def score(self, text: str | None) -> float:
        good, weight = self.lines(text)
        x = self.slope * float(good @ weight / weight.sum()) + self.offset
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def _chain_gradient(scores, labels, mask, transitions, weight):
    """Gradients of the weighted log likelihood of padded sequences (n x time)."""
    n, length = scores.shape
    unary = np.stack((np.zeros_like(scores), scores), axis=2)
    move = np.exp(transitions)
    emit = np.exp(unary - unary.max(axis=2, keepdims=True))
    ahead = np.zeros((length, n, 2))
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    ahead[0] = a
    for t in range(1, length):
        x = (a @ move) * emit[:, t]
        x /= x.sum(1, keepdims=True)
        a = np.where(mask[:, t, None], x, a)
        ahead[t] = a
    back = np.ones((n, 2))
    good, pairs, seen = np.zeros_like(scores), np.zeros((2, 2)), np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        x = ahead[t] * back
        good[:, t] = x[:, 1] / x.sum(1)
        if t:
            own = emit[:, t] * back
            joint = ahead[t - 1][:, :, None] * move[None] * own[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            use = mask[:, t]
            pairs += (joint[use] * weight[use, None, None]).sum(0)
            np.add.at(seen, (labels[use, t - 1], labels[use, t]), weight[use])
            new = own @ move.T
            back = np.where(use[:, None], new / new.sum(1, keepdims=True), back)
    return (labels - good) * mask * weight[:, None], seen - pairs


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """``samples``: (label, own line features, line weights) of each document."""
    kinds = {y for y, _, _ in samples}
    size = 3 * N_OWN + 1
    if kinds != {0, 1}:
        return Model(np.zeros(size), np.zeros((2, 2)), 0.0, 0.0)
    pieces, owner = [], []
    for d, (_, own, _) in enumerate(samples):
        x = with_neighbours(own)
        for i in range(0, len(x), PIECE):
            pieces.append(x[i : i + PIECE])
            owner.append(d)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    truth = np.array([y for y, _, _ in samples])
    share = np.array([y for y, _, _ in samples]).mean()
    labels = [np.full(len(p), truth[d]) for p, d in zip(pieces, owner, strict=True)]
    stacks = []
    for i in range(0, len(order), 512):
        some = order[i : i + 512]
        longest = max(len(pieces[j]) for j in some)
        x, mask = np.zeros((len(some), longest, size), np.float32), np.zeros((len(some), longest), bool)
        for r, j in enumerate(some):
            x[r, : len(pieces[j])], mask[r, : len(pieces[j])] = pieces[j], True
        stacks.append((some, x, mask))
    weights, transitions = np.zeros(size), np.zeros((2, 2))
    n_lines = sum(map(len, pieces))
    # Both kinds of document count alike, whatever their number.
    balance = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share))
    for turn in range(ROUNDS):
        m = v = np.zeros(size + 4)
        for step in range(1, STEPS + 1):
            gw, gt = -L2 * n_lines * weights, -10 * L2 * n_lines * transitions
            for some, x, mask in stacks:
                y = np.zeros(mask.shape, int)
                for r, j in enumerate(some):
                    y[r, : len(labels[j])] = labels[j]
                down, pair = _chain_gradient(np.clip(x @ weights, -30, 30), y, mask, transitions, balance[[owner[j] for j in some]])
                gw += np.einsum("rt,rtf->f", down, x)
                gt += pair
            g = np.concatenate((gw, gt.ravel())) / n_lines
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            weights, transitions = weights + move[:size], np.clip(transitions + move[size:].reshape(2, 2), -4, 4)
        if turn == ROUNDS - 1:
            break
        found = [marginals(np.clip(p @ weights, -30, 30), transitions) for p in pieces]
        worst: dict[int, float] = {}
        for d, f in zip(owner, found, strict=True):
            worst[d] = min(worst.get(d, 1.0), float(f.min()))
        labels = [np.ones(len(f), int) if truth[d] else (f > max(0.5, worst[d])).astype(int) for d, f in zip(owner, found, strict=True)]
    means = np.array([marginals(np.clip(with_neighbours(own) @ weights, -30, 30), transitions) @ w / w.sum() for _, own, w in samples])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method with a light prior on the slope
        p = 1 / (1 + np.exp(-np.clip(slope * means + offset, -30, 30)))
        r, c = truth - p, p * (1 - p) + 1e-9
        h = np.array([[(c * means * means).sum() + 1e-2, (c * means).sum()], [(c * means).sum(), c.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([(r * means).sum() - 1e-2 * slope, r.sum()]))
        slope, offset = slope + d[0], offset + d[1]
        if np.abs(d).max() < 1e-6:
            break
    return Model(weights, transitions, float(slope), float(offset))


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Fits a model; what reaches the driver are line features of ``bound`` documents."""

    def features(batches):
        for doc, label, text in rows_of(batches, "doc_id", "label", "text"):
            own, weight = line_features(text)
            yield doc, label, len(own), own.astype("<f4").tobytes(), weight.astype("<f4").tobytes()

    sample = training_sample(docs, labels, "quality", bound)
    rows = map_rows(sample, features, "doc_id long, label int, n int, own binary, weight binary").orderBy("doc_id").collect()
    return fit([(r.label, np.frombuffer(r.own, "<f4").reshape(r.n, N_OWN).astype(float), np.frombuffer(r.weight, "<f4").astype(float)) for r in rows])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Adds the score of ``text`` to all columns."""
    names = [c for c in docs.columns if c != column]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != column)

    def scored(batches):
        for *rest, text in rows_of(batches, *names, "text"):
            yield *rest, model.score(text)

    return map_rows(docs, scored, f"{kinds}, `{column}` double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: every document's quality."""
    model = learn(docs, labels)

    def scored(batches):
        for doc, text in rows_of(batches, "doc_id", "text"):
            yield doc, model.score(text)

    found = map_rows(docs.select("doc_id", "text"), scored, "doc_id long, score double", size=4096)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
