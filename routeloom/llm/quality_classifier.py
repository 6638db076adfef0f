"""Quality classifier: a linear support vector machine on naive-Bayes scaled n-gram indicators.

Features of a text are indicators of its byte trigrams and of 1- and 2-grams of word
shapes (case, digits, symbols at either end, length, and whether the word before is the same), hashed into
``2**bits`` slots.  Each indicator is scaled by the log ratio of its smoothed frequencies in the two classes; the
scaled vector has length 1.  A hinge-loss model is fitted by dual coordinate descent, and a sigmoid fitted on
margins of rows that the fold's model has not seen turns margins into scores.

Bound: about ``sample`` labelled rows are learned from, chosen by a hash of the id over all labelled rows, each with its whole
text.  A row's features are a list of slots or, if that is shorter, a bitmap of all slots, so learning takes at most
``sample * 2**bits / 8`` bytes (288 MB), however long the texts are.  Every text is scored whole.

Defined cases: null and empty texts have no feature and get the score of a zero vector; null labels are not
learned from; an id labelled several times counts with its largest label; with one
class or no row to learn from all scores are that class's share (0.5 without rows); a very long text is one row like any other;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm import kernels as K
from routeloom.llm.blocks import pack, unpack

_KIND = np.full(256, 4, np.int64)  # other symbols
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[128:] = 3
_KIND[[ord(c) for c in ".,;:"]] = 5


def features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the distinct features of each text of a slab, in order."""
    n = len(data)
    doc_at = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    d, f = [], []
    if n > 2:
        inside = doc_at[2:] == doc_at[:-2]
        x = data.astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        d.append(doc_at[2:][inside])
        f.append(slot[inside])
    starts, ends, doc = K.words(data, offs)
    if len(starts):
        one, two = K.digests(data, starts, ends)
        upper = np.concatenate(([0], np.cumsum(_KIND[data] == 1)))
        shape = _KIND[data[starts]] * 6 + _KIND[data[ends - 1]]
        shape = shape * 6 + _KIND[data[np.maximum(ends - 2, starts)]]
        shape = shape * 2 + (upper[ends] - upper[starts] > 1)
        shape = shape * 4 + np.minimum(3, (ends - starts) // 4)
        same = np.zeros(len(doc), np.int64)
        same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (doc[1:] == doc[:-1])
        shape = (shape * 2 + same).astype(K.U)
        top = K.U(64 - bits)
        d.append(doc)
        f.append((K.mix(shape + K.U(1 << 40)) >> top).astype(np.uint32))
        pair = doc[1:] == doc[:-1]
        d.append(doc[1:][pair])
        f.append((K.mix(shape[1:] * K.U(1 << 20) + shape[:-1] + K.U(1 << 50))[pair] >> top).astype(np.uint32))
    if not d:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, slots = np.concatenate(d), np.concatenate(f)
    if (len(offs) << bits) < 1 << 32:
        key = np.unique((docs.astype(np.uint32) << np.uint32(bits)) | slots).astype(np.int64)
    else:
        key = np.unique((docs.astype(np.int64) << bits) | slots)
    return key >> bits, key & ((1 << bits) - 1)


def packed(slots: np.ndarray, bits: int) -> bytes:
    """Distinct slots as a list of 32-bit numbers or as a bitmap, whichever is shorter."""
    if 32 * len(slots) < 1 << bits:
        return slots.astype(np.int32).tobytes()
    marks = np.zeros(1 << bits, bool)
    marks[slots] = True
    return b"\0" + np.packbits(marks).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) % 4:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1)))
    return np.frombuffer(raw, np.int32).astype(np.int64)


class Rows:
    """Packed feature rows, opened one at a time."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.raw[i])

    def of(self, which: np.ndarray) -> Rows:
        return Rows([self.raw[i] for i in which])


def log_count_ratio(rows: Rows, y: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    out = []
    for label in (1, -1):
        c = np.full(1 << bits, smooth)
        for i in np.flatnonzero(y == label).tolist():
            c[rows[i]] += 1  # a row's slots are distinct
        out.append(np.log(c / c.sum()))
    return out[0] - out[1]


def _scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[row]
    return v / max(1e-12, float(np.sqrt((v * v).sum())))


def descend(rows: Rows, y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes weigh the same in total."""
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    share = {1: max(1, int((y > 0).sum())), -1: max(1, int((y < 0).sum()))}
    most = np.array([cost * len(y) / (2 * share[t]) for t in y])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = _scaled(r, ratio)
            gradient = y[i] * (float(v @ w[r]) + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])  # the squared length with the constant is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                b += step
                alpha[i] = new
    return w, b


def margins(rows: Rows, ratio: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([float(_scaled(rows[i], ratio) @ w[rows[i]]) + b for i in range(len(rows))])


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve of the margins (Newton steps with smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + c)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(c)


def train(rows: Rows, labels: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 8):
    """(ratio, w, b, slope, intercept)."""
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        p = float((y > 0).mean()) if len(y) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0, float(np.log(p / (1 - p)))
    fold = np.arange(len(rows)) % 3
    m = np.zeros(len(rows))
    for k in range(3):
        seen, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[seen].tolist())) < 2:
            continue
        own = rows.of(seen)
        ratio = log_count_ratio(own, y[seen], bits)
        m[rest] = margins(rows.of(rest), ratio, *descend(own, y[seen], ratio, cost, epochs))
    a, c = sigmoid_fit(m, y)
    ratio = log_count_ratio(rows, y, bits)
    w, b = descend(rows, y, ratio, cost, epochs)
    return ratio, w, b, a, c


def fit(docs: DataFrame, labels: DataFrame, split: Column, *, sample: int = 9000, bits: int = 18):
    """Learn ``labels.label`` of the rows for which ``split`` (over doc_id) holds."""
    known = labels.where(split & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    total = known.count()
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    few = known.where(dice < min(1.0, sample / max(1, total))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in K.slabs(batch.column(1)):
                doc, slot = features(data, offs, bits)
                own = np.split(slot, np.searchsorted(doc, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([packed(x, bits) for x in own], pa.binary())],
                    ["doc_id", "label", "slots"],
                )

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("slots", "ascending")])
        ratio, w, b, a, c = train(Rows(table["slots"].to_pylist()), table["label"].to_numpy(), bits)
        return pa.table({"ratio": pa.array([pack(ratio)], pa.binary()), "w": pa.array([pack(w)], pa.binary()), "b": [b], "a": [a], "c": [c]})

    kind = dict(docs.dtypes)["doc_id"]
    found = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(extract, f"doc_id {kind}, label int, slots binary")
    shape = "ratio binary, w binary, b double, a double, c double"
    got = found.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(learn, shape).collect()
    if not got:
        return None
    r = got[0]
    return unpack(r["ratio"], np.float64), unpack(r["w"], np.float64), r["b"], r["a"], r["c"]


def score(docs: DataFrame, model, *, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, margin and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None:
            ratio, w, b, a, c = model
            gain, square = (ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32)
        for batch in batches:
            for lo, hi, data, offs in K.slabs(batch.column(1)):
                n = hi - lo
                margin, out = np.zeros(n), np.full(n, 0.5)
                if model is not None:
                    doc, slot = features(data, offs, bits)
                    margin = np.bincount(doc, gain[slot], n) / np.sqrt(np.maximum(np.bincount(doc, square[slot], n), 1e-24)) + b
                    out = 1 / (1 + np.exp(-np.clip(a * margin + c, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(margin), pa.array(out)], ["doc_id", "margin", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, margin double, score double")
