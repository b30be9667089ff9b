"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters. A token's emission is the sum of the weights of its word and of
its first four, five and six bytes, if those are in the model's vocabulary, else one background
value. Words and stems that mark labelled toxic documents label the tokens that the field learns
from. Scoring is exact forward-backward over the whole text: between tokens with features all
emissions are alike, so a gap of n tokens is the n-th power of one 2 x 2 matrix, in closed form.
Marginals above ``SPAN`` give offsets; their sum and largest value, calibrated on the same labelled rows,
give the score.

What is fitted has bounds that are parameters: labelled rows (``MAX_TRAIN_ROWS``, drawn evenly by hash), features (``MAX_FEATURES``, the
strongest) and windows without any of them (``BACKGROUND``, which are all alike). Scoring has none: every token of every text counts.

Only texts are inputs of a score. Nulls: a null text is empty and scores like any text without
evidence; labels that are null, or that belong to no document, aren't learnt from. Several labels for one
document are all used. Ties in the draw of labelled rows are broken by doc_id, label and text. Without any labels of both kinds the score
is 0 everywhere. Repeated rows get equal rows; an empty table gives an empty result. Columns besides doc_id and text aren't read, whatever
their names; ``keep_clean`` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import ship
from .text import Words, pieces, separators, text_buffers, words_of

#: Bound on the labelled rows that are fitted, drawn evenly by hash.
MAX_TRAIN_ROWS = 5000
MAX_FEATURES = 4096
#: Windows without a feature that are fitted: all are alike, so they only weigh the background. Windows with one are all fitted.
BACKGROUND = 1000
BATCH = 4096  # windows whose gradient is taken at once
SPAN = 0.5
PREFIXES = (4, 5, 6)
_LETTERS = separators(bytes(b for b in range(128) if not chr(b).isalpha()))
_P = 1 << 16


def features(words: Words) -> np.ndarray:
    """Feature hashes, one row per kind: the word, then each prefix (0 where the word isn't longer)."""
    from .text import mix

    whole = words.hashes(lower=True)
    out = [whole]
    length = words.end - words.start
    for k in PREFIXES:
        cut = Words(words.buffer, words.start, np.minimum(words.start + k, words.end), words.first)
        h = mix(cut.hashes(lower=True) ^ np.uint64(k))
        h[length <= k] = 0
        out.append(h)
    return np.stack(out)


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    background: float = -20.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # logarithms
    calibration: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def __post_init__(self):
        self.sieve = np.zeros(_P, dtype=bool)
        self.sieve[(self.keys & np.uint64(_P - 1)).astype(np.int64)] = True

    def active(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens with features, and the sums of their weights."""
        place, weight = [], []
        for row in feats:
            at = np.flatnonzero(self.sieve[(row & np.uint64(_P - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, row[at]), max(0, len(self.keys) - 1))
            ok = self.keys[k] == row[at] if len(self.keys) else np.zeros(len(at), dtype=bool)
            place.append(at[ok])
            weight.append(self.weights[k[ok]] if len(self.keys) else np.zeros(0))
        place, weight = np.concatenate(place), np.concatenate(weight)
        unique, inverse = np.unique(place, return_inverse=True)
        return unique, np.bincount(inverse, weights=weight, minlength=len(unique))

    def power(self, n: np.ndarray) -> np.ndarray:
        """The n-th power of a background token's matrix, scaled by its largest eigenvalue: [n, 2, 2]."""
        m = np.exp(self.transition + np.array([0.0, self.background]))
        trace, det = m[0, 0] + m[1, 1], m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
        root = np.sqrt(max(trace * trace / 4 - det, 1e-300))
        big, small = trace / 2 + root, trace / 2 - root
        first = (m - small * np.eye(2)) / (big - small)
        ratio = (small / big) ** n.astype(float)
        return first + ratio[:, None, None] * (np.eye(2) - first)

    def marginals(self, first: np.ndarray, place: np.ndarray, emission: np.ndarray) -> np.ndarray:
        """P(toxic) of the tokens at ``place`` (sorted), of documents with token bounds ``first``."""
        out = np.zeros(len(place))
        low = np.searchsorted(place, first)
        count = np.diff(low)
        docs = np.flatnonzero(count)
        docs = docs[np.argsort(-count[docs], kind="stable")]
        if not len(docs):
            return out
        a = np.exp(self.transition)
        local = np.exp(np.clip(emission, -50, 50))
        before = np.concatenate([[0], place[:-1] + 1])
        at_start = low[:-1][docs]
        gap = place - before
        gap[at_start] = place[at_start] - first[docs]
        alpha = np.zeros((len(place), 2))
        state = np.tile([1.0, 0.0], (len(docs), 1))
        steps = int(count[docs[0]])
        live = [int((count[docs] > k).sum()) for k in range(steps)]
        for k in range(steps):
            i = at_start[: live[k]] + k
            s = np.einsum("ni,nij->nj", state[: live[k]], self.power(gap[i])) @ a
            s[:, 1] *= local[i]
            s /= s.sum(axis=1, keepdims=True)
            alpha[i] = state[: live[k]] = s
        tail = first[1:][docs] - place[at_start + count[docs] - 1] - 1
        beta = np.einsum("nij,j->ni", self.power(tail), np.ones(2))
        for k in range(steps - 1, -1, -1):
            i = at_start[: live[k]] + k
            b = beta[: live[k]]
            joint = alpha[i] * b
            out[i] = joint[:, 1] / joint.sum(axis=1)
            b = b * np.stack([np.ones(len(i)), local[i]], axis=1)
            b = np.einsum("nij,nj->ni", self.power(gap[i]), b @ a.T)
            beta[: live[k]] = b / b.sum(axis=1, keepdims=True)
        return out

    def spans(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        place, weight = self.active(features(words))
        return place, self.marginals(words.first, place, weight + self.background)

    def evidence(self, words: Words) -> np.ndarray:
        place, p = self.spans(words)
        doc = np.searchsorted(words.first, place, side="right") - 1
        n = len(words.first) - 1
        top = np.zeros(n)
        np.maximum.at(top, doc, p)
        return np.stack([np.ones(n), np.log1p(np.bincount(doc, weights=p * (p > 0.05), minlength=n)), top], axis=1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.calibration, -500, 500)))


def _mine(docs: list[np.ndarray], toxic: np.ndarray, most: int) -> np.ndarray:
    """Features that a document's toxicity explains and chance does not, each strong by itself or the best of some document."""
    own = [np.unique(f) for f in docs]
    own = [f[f != 0] for f in own]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    keys, one = np.unique(np.concatenate([f for f, y in zip(own, toxic) if y]), return_counts=True)
    zero = np.zeros(len(keys))
    for f in (f for f, y in zip(own, toxic) if not y):
        zero[np.searchsorted(keys, f[np.isin(f, keys, assume_unique=True)])] += 1
    rate, base, share = one / n1, (zero + 0.5) / (n0 + 1), n1 / (n1 + n0)
    total = one + zero
    p = np.clip(one / total, 1e-9, 1 - 1e-9)
    surprise = total * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))  # log-likelihood ratio
    least = max(9.0, np.log(max(1, int((one >= 2).sum()))))
    good = (one >= 2) & (rate > 6 * base) & (surprise > least) & (p > max(0.5, 3 * share))
    order = np.flatnonzero(good)[np.argsort(-surprise[good], kind="stable")][:most]
    holders: dict[int, list[int]] = {int(keys[k]): [] for k in order}
    wanted = np.sort(keys[order])
    for d, (f, y) in enumerate(zip(own, toxic)):
        if y and len(wanted):
            for k in f[np.isin(f, wanted, assume_unique=True)].tolist():
                holders[k].append(d)
    explained: set[int] = set()
    out = []
    for k in order:
        if surprise[k] > 2 * least or not explained.issuperset(holders[int(keys[k])]):
            out.append(keys[k])
            explained.update(holders[int(keys[k])])
    return np.array(out, dtype=np.uint64)


def _field(x: list[np.ndarray], gold: np.ndarray, n_features: int, steps: int = 60, l2: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Fits the field by gradient ascent on the likelihood of all sequences, summed over batches of them. x: per feature kind the feature's number or -1, [sequence, token]; gold: 0, 1 or -1 for padding."""
    w, bias, trans = np.full(n_features, 2.0), -4.0, np.array([[2.0, -2.0], [0.0, 0.0]])
    theta = np.concatenate([w, [bias], trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_tokens = int((gold >= 0).sum())
    for step in range(1, steps + 1):
        grad = np.zeros_like(theta)
        for low in range(0, len(gold), BATCH):
            grad += _gradient(theta, [k[low : low + BATCH] for k in x], gold[low : low + BATCH], n_features)
        grad = grad / max(1.0, n_tokens**0.5) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def _gradient(theta: np.ndarray, x: list[np.ndarray], gold: np.ndarray, n_features: int) -> np.ndarray:
    n, length = gold.shape
    mask = (gold >= 0).astype(float)
    y = np.maximum(gold, 0)
    pair = np.zeros((2, 2))
    before = np.concatenate([np.zeros((n, 1), dtype=int), y[:, :-1]], axis=1)
    np.add.at(pair, (before[mask > 0], y[mask > 0]), 1)
    w, bias, trans = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
    e = np.full((n, length), bias)
    for k in x:
        e += np.where(k >= 0, w[np.maximum(k, 0)], 0)
    local = np.ones((n, length, 2))
    local[:, :, 1] = np.exp(np.clip(e, -40, 40))
    a = np.exp(trans)
    alpha, scale = np.zeros((n, length, 2)), np.ones((n, length))
    s = np.tile([1.0, 0.0], (n, 1))
    for t in range(length):
        new = (s @ a) * local[:, t]
        c = new.sum(axis=1)
        new /= c[:, None]
        on = mask[:, t : t + 1] > 0
        s = np.where(on, new, s)
        alpha[:, t], scale[:, t] = s, np.where(mask[:, t] > 0, c, 1)
    beta = np.ones((n, 2))
    expect, post = np.zeros((2, 2)), np.zeros((n, length))
    for t in range(length - 1, -1, -1):
        on = mask[:, t] > 0
        prev = alpha[:, t - 1] if t else np.tile([1.0, 0.0], (n, 1))
        nxt = local[:, t] * beta / scale[:, t][:, None]
        post[:, t] = np.where(on, alpha[:, t, 1] * beta[:, 1] / np.maximum((alpha[:, t] * beta).sum(axis=1), 1e-300), 0)
        expect += np.einsum("ni,ij,nj->ij", prev[on], a, nxt[on])
        beta = np.where(on[:, None], nxt @ a.T, beta)
    diff = (y - post) * mask
    grad = np.zeros_like(theta)
    for k in x:
        ok = (k >= 0) & (mask > 0)
        grad[:n_features] += np.bincount(k[ok], weights=diff[ok], minlength=n_features)
    grad[n_features] = diff.sum()
    grad[n_features + 1 :] = (pair - expect).ravel()
    return grad


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], window: int = 32, max_features: int = MAX_FEATURES, background: int = BACKGROUND) -> Model:
    """Learns from whole texts and their labels: all windows that hold one of the ``max_features`` strongest features, and ``background`` of those without any."""
    y = np.array(toxic, dtype=bool)
    if not y.any() or y.all():
        return Model()
    buffer, offsets = text_buffers(pa.array(texts, pa.string()))
    feats, bounds = [], []
    for low in range(0, len(texts), 500):
        high = min(low + 500, len(texts))
        w = words_of(buffer[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], _LETTERS)
        f = features(w)
        feats += [f[:, w.first[i] : w.first[i + 1]] for i in range(high - low)]
        bounds.append(w.first)
    keys = np.sort(_mine(feats, y, max_features))
    if not len(keys):
        return Model()
    rows, gold, plain = [], [], []
    for f, t in zip(feats, y):
        at = np.searchsorted(keys, f)
        at = np.where(keys[np.minimum(at, len(keys) - 1)] == f, np.minimum(at, len(keys) - 1), -1)
        hit = (at >= 0).any(axis=0)
        n = f.shape[1]
        for low in range(0, n, window):
            part = at[:, low : low + window]
            own = np.where(hit[low : low + window], int(t), 0)
            if hit[low : low + window].any():
                rows.append(part.copy()), gold.append(own)
            elif len(plain) < background:
                plain.append((part.copy(), own))
    rows, gold = rows + [b[0] for b in plain], gold + [b[1] for b in plain]
    x = np.full((len(feats[0]), len(rows), window), -1, dtype=np.int32)
    g = np.full((len(rows), window), -1, dtype=np.int64)
    for i, (r, o) in enumerate(zip(rows, gold)):
        x[:, i, : r.shape[1]] = r
        g[i, : len(o)] = o
    w, bias, trans = _field(list(x), g, len(keys))
    model = Model(keys, w, bias, trans)
    evidence = []
    for low in range(0, len(texts), 500):
        high = min(low + 500, len(texts))
        evidence.append(model.evidence(words_of(buffer[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], _LETTERS)))
    model.calibration = _logistic(np.concatenate(evidence), y.astype(float))
    return model


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled rows that aren't held out."""
    ship(documents.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", "toxic").limit(max_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text").limit(max_rows)  # a doc_id may be in many rows
    learnt = rows.repartition(1).mapInPandas(_learn, "name string, data binary").collect()  # one task of bounded rows; the driver gets parameters
    if not learnt:
        return Model()
    part = {r.name: np.frombuffer(bytes(r.data), dtype="<u8" if r.name == "keys" else "<f8") for r in learnt}
    return Model(part["keys"], part["weights"], float(part["background"][0]), part["transition"].reshape(2, 2), part["calibration"])


def _learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if held:
        rows = pd.concat(held).sort_values(["doc_id", "toxic", "text"], kind="stable")
        m = fit([t if isinstance(t, str) else None for t in rows.text], rows.toxic.tolist())
        parts = {"keys": m.keys.astype("<u8"), "weights": m.weights, "background": np.array([m.background]), "transition": m.transition, "calibration": m.calibration}
        yield pd.DataFrame({"name": list(parts), "data": [np.ascontiguousarray(v, dtype="<u8" if k == "keys" else "<f8").tobytes() for k, v in parts.items()]})


def _score(model: Model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                words = words_of(buffer, offsets, _LETTERS)
                place, p = model.spans(words)
                doc = np.searchsorted(words.first, place, side="right") - 1
                n = part.num_rows
                top = np.zeros(n)
                np.maximum.at(top, doc, p)
                evidence = np.stack([np.ones(n), np.log1p(np.bincount(doc, weights=p * (p > 0.05), minlength=n)), top], axis=1)
                columns = [part.column("doc_id"), pa.array(model.scores(evidence))]
                if with_spans:
                    found: list[list[dict]] = [[] for _ in range(n)]
                    for d, k, q in zip(doc.tolist(), place.tolist(), p.tolist()):
                        if q >= SPAN:
                            at, a, b = int(offsets[d]), int(words.start[k]), int(words.end[k])
                            found[d].append({"start": len(bytes(buffer[at:a]).decode()), "end": len(bytes(buffer[at:b]).decode()), "p": q})
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                yield pa.record_batch(columns, ["doc_id", "score"] + ["spans"] * with_spans)

    return run


def score(documents: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id and score; ``with_spans`` adds the offending tokens as code point offsets with their marginals."""
    ship(documents.sparkSession)
    key = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, score double" + ", spans array<struct<start:int, end:int, p:double>>" * with_spans
    return documents.select("doc_id", "text").mapInArrow(_score(model, with_spans), schema)


def toxicity(documents: DataFrame, labels: DataFrame, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and spans)."""
    scored = score(documents, train(documents, labels), with_spans)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["spans"] * with_spans)


def keep_clean(documents: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Documents with a score below ``limit``, with all their columns, in one pass over them."""
    ship(documents.sparkSession)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                yield part.filter(pa.array(model.scores(model.evidence(words_of(buffer, offsets, _LETTERS))) < limit))

    return documents.mapInArrow(run, documents.schema).select(*names)
