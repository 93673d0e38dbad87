"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Each passage is encoded: the
shares of its pairs of byte classes and of its repeated words go through a hidden layer. Gated
attention weighs the passages of a bag against each other, the weighted sum stands for the
document, and a logistic layer scores it. All layers are learnt together from document labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbuf import Packed, ranges, slices, words

#: Words of a passage.
PASSAGE_WORDS = 64
#: Classes of bytes: lower-case letters, capitals, digits, bytes beyond ASCII, space, line end, then marks by kind.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", " \t\r\v\f", "\n", ".", ",;:", "!?", "'\"()[]{}", "#*$%&@^~+=", "|<>\\/", "-_"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_CLASS[0x80:] = 3
_N = len(_CLASSES) + 1
#: Besides pairs of classes: words equal to the word before, to an earlier one of the passage, lines, mean length of words and words, both by their logarithm.
N_FEATURES = _N * _N + 5


def passages(buf: np.ndarray, offs: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features (passage, feature) of all passages of a slice, and the first passage of each text (n + 1 numbers).

    A text without words has one passage, of noughts.
    """
    start, end, first = words(buf, offs)
    count = np.diff(first)
    n = np.maximum(-(-count // size), 1)
    bag = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(count)), count)
    passage = bag[row] + (np.arange(len(start)) - first[row]) // size
    out = np.zeros((bag[-1], N_FEATURES), np.float32)
    if not len(start):
        return out, bag
    opens = np.ones(len(start), bool)
    opens[1:] = np.diff(passage) != 0
    lead = np.flatnonzero(opens)
    # a passage reaches to the next one of its text, or to the text's end
    stop = np.append(start[lead[1:]], offs[-1])
    last = np.append(row[lead[1:]] != row[lead[:-1]], True)
    stop = np.where(last, offs[row[lead] + 1], stop)
    owner = passage[lead]
    # pairs of classes within each passage
    pair = _CLASS[buf[:-1]].astype(np.int64) * _N + _CLASS[buf[1:]]
    at = np.repeat(owner * (_N * _N), np.maximum(stop - start[lead] - 1, 0))
    where = ranges(start[lead], np.maximum(stop - start[lead] - 1, 0))
    pairs = np.bincount(at + pair[where], minlength=len(out) * _N * _N).reshape(len(out), _N * _N)
    out[:, : _N * _N] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    h = Packed.of(buf, start, end).numbers()
    total = np.bincount(passage, minlength=len(out))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, passage))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    share = lambda x, k: np.bincount(k, x, len(out)) / np.maximum(total, 1)
    out[:, -5] = share(same, passage)
    out[:, -4] = share(again, passage[order])
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = np.zeros(len(out))
    lines[owner] = breaks[stop] - breaks[start[lead]]
    out[:, -3] = lines / np.maximum(total, 1)
    out[:, -2] = np.log1p(share(end - start, passage)) / 4
    out[:, -1] = np.log1p(total) / 5
    return out, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 2):
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.w = {"e": draw(N_FEATURES, hidden), "eb": np.zeros(hidden, np.float32), "v": draw(hidden, attention), "u": draw(hidden, attention), "a": draw(attention, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def _forward(self, x: np.ndarray, bag: np.ndarray):
        w = self.w
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        h = np.tanh(x @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        raw = (t * s) @ w["a"]
        n = np.diff(bag)
        top = np.maximum.reduceat(raw, bag[:-1])
        weight = np.exp(raw - np.repeat(top, n))
        weight /= np.repeat(np.add.reduceat(weight, bag[:-1]), n)
        z = np.add.reduceat(h * weight[:, None], bag[:-1], axis=0)
        return x, h, t, s, weight, z, _sigmoid(z @ w["c"] + w["b"][0])

    def attend(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags, and weights of passages (of each bag they sum to 1)."""
        if len(bag) < 2:
            return np.zeros(0), np.zeros(0)
        *_, weight, _, p = self._forward(x, bag)
        return p.astype(np.float64), weight

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, n = self.w, np.diff(bag)
        x, h, t, s, weight, z, p = self._forward(x, bag)
        loss = -float(np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        d = ((p - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * w["c"], n, axis=0)
        dweight = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(weight * dweight, bag[:-1]), n)
        draw = weight * (dweight - mean)
        dts = draw[:, None] * w["a"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = dz * weight[:, None] + dt @ w["v"].T + ds @ w["u"].T
        dx = dh * (1 - h * h)
        return loss, {"e": x.T @ dx, "eb": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ draw, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, rounds: int = 400, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> float:
        """Adam with a falling rate over so many batches of bags; the last batches' mean loss."""
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.01)
        m, v, losses, n = {k: 0 for k in self.w}, {k: 0 for k in self.w}, [], np.diff(bag)
        for i in range(1, rounds + 1):
            pick = r.integers(0, len(y), batch)
            loss, g = self.gradients(x[ranges(bag[pick], n[pick])], np.concatenate([[0], np.cumsum(n[pick])]), y[pick])
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                step = (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
                self.w[k] = (self.w[k] - rate * (1 - 0.95 * i / rounds) * (step + decay * self.w[k])).astype(np.float32)
            losses.append(loss)
        return float(np.mean(losses[-20:]))


def learn(bags: list[tuple[int, np.ndarray]], **options) -> AttentionMil | None:
    """A classifier from (label, features of its passages) bags; None without bags."""
    if not bags:
        return None
    model = AttentionMil()
    x = np.concatenate([b for _, b in bags])
    bag = np.concatenate([[0], np.cumsum([len(b) for _, b in bags])])
    model.fit(x, bag, np.array([y for y, _ in bags], np.float32), **options)
    return model


def train(pairs: list[tuple[int, str]], **options) -> AttentionMil | None:
    """A classifier from (label, text) pairs; None without pairs."""
    bags, done = [], 0
    for lo, hi, buf, offs in slices(pa.array([t for _, t in pairs], pa.large_string())):
        x, bag = passages(buf, offs)
        bags += [(pairs[lo + i][0], x[bag[i] : bag[i + 1]]) for i in range(hi - lo)]
        done = hi
    assert done == len(pairs)
    return learn(bags, **options)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 2000, **options) -> AttentionMil | None:
    """A classifier trained on at most most_docs labelled documents, drawn by a hash of their ids.

    All passages of their whole texts count; they come to the driver as features, about twice the
    text's bytes. Labels are 0 or 1; rows with a null label, id or text are passed over. Of several
    rows with one id (and label) the text with the least hash counts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).distinct()
    drawn = known.orderBy(F.xxhash64(F.lit(8), F.col("key").cast("string")), "label").limit(most_docs)  # bounded, so it may be broadcast
    d = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    one = d.join(F.broadcast(drawn), "key").groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                x, bag = passages(buf, offs)
                parts = [x[bag[i] : bag[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(parts, pa.binary())], names=["key", "label", "features"])

    rows = one.select(F.col("key").cast("string").alias("key"), "label", "x.text").mapInArrow(run, "key string, label int, features binary").collect()
    rows.sort(key=lambda r: (r["key"], r["label"]))
    return learn([(r["label"], np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES)) for r in rows], **options)


def score(docs: DataFrame, model: AttentionMil | None, *, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """<id_col>, score (double, 0 to 1: higher, label 1 is likelier), n_passages and top_passage (long: the number of the passage that weighs most) of every row.

    Whole texts are read. A null or empty text is one passage without words, scored like any other;
    of passages that weigh the same the first is top_passage.
    Without a model every score is 0.5. Repeated rows get equal scores; an empty table gives no
    rows. Only the two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                x, bag = passages(buf, offs)
                p, weight = m.attend(x, bag) if m is not None else (np.full(hi - lo, 0.5), np.zeros(len(x)))
                order = np.lexsort((-weight, np.repeat(np.arange(hi - lo), np.diff(bag))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(np.diff(bag)), pa.array(order[bag[:-1]] - bag[:-1])], names=["key", "score", "n_passages", "top_passage"])

    two = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(run, f"key {kind}, score double, n_passages bigint, top_passage bigint").select(F.col("key").alias(id_col), F.col("score").alias(score_col), "n_passages", "top_passage")
