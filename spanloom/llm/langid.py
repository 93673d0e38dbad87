"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into windows of bytes. Two recurrent layers read each window, one from either end;
what both know at a byte gives probabilities of the languages there. A document's probabilities are
the geometric mean of those at all its letters, scaled to a sum of 1. Training is backpropagation
through time over whole windows: fit() learns from a bounded sample of labelled documents, fit_all()
goes on from there through all windows of all of them, by learners whose weights are averaged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbuf import give_back, ranges, slices

UNKNOWN = "und"
#: Bytes of text, about, that one learner goes through, and that one task of floors() has, which scores several times as much.
LEARNER_BYTES, FLOOR_BYTES = 8 << 20, 2 << 20
#: Weights are averaged as integers of this scale, so their sum is the same in any order.
FIXED = 1 << 24
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; 1 / (1 + exp(-x))."""
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, from the exponential, which numpy has vectorised everywhere."""
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


class BiGru:
    """Arrays have the hidden unit first and the window last. Gates stand in the order update, reset, candidate."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.w[f"u{d}"] = r.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        self.w["o"] = r.normal(0, (2 * hidden) ** -0.5, (len(labels), 2 * hidden)).astype(np.float32)
        self.w["c"] = np.zeros((len(labels), 1), np.float32)

    def _layer(self, d: str, ids: np.ndarray, keep: bool):
        """States after each byte of (time, window) ids, and what training needs of each step."""
        h, x, u = self.hidden, self.w[f"x{d}"], self.w[f"u{d}"]
        steps, n = ids.shape
        state, states, tape = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x.take(ids[t], axis=1)
            g = u @ state
            gates = a[: 2 * h]
            gates += g[: 2 * h]
            _sigmoid(gates)
            z, r = gates[:h], gates[h:]
            cand = a[2 * h :]
            cand += r * g[2 * h :]
            _tanh(cand)
            if keep:
                tape.append((t, z, r, cand, g[2 * h :], state))
            new = state - cand
            new *= z
            new += cand
            states[t] = state = new
        return states, tape

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """(time, label, window)"""
        f, _ = self._layer("f", ids, False)
        b, _ = self._layer("b", ids, False)
        h = self.hidden
        y = self.w["o"][:, :h] @ f
        y += self.w["o"][:, h:] @ b
        y += self.w["c"]
        e = np.exp(y)
        y -= np.log(e.sum(axis=1, keepdims=True))
        return y

    def gradients(self, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over weighted bytes (time, window), and its gradients."""
        h, w = self.hidden, self.w
        f, ft = self._layer("f", ids, True)
        b, bt = self._layer("b", ids, True)
        s = np.concatenate([f, b], axis=1)
        y = w["o"] @ s + w["c"]
        y -= y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        total = max(float(weight.sum()), 1.0)
        at = np.arange(ids.shape[1])
        loss = -float((np.log(p[:, label, at] + 1e-12) * weight).sum()) / total
        p[:, label, at] -= 1
        p *= (weight / total)[:, None, :]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"] = (p @ s.transpose(0, 2, 1)).sum(axis=0).astype(np.float32)
        g["c"] = p.sum(axis=(0, 2))[:, None]
        back, flat = w["o"].T @ p, ids.ravel().astype(np.intp)
        for d, tape, lo in (("f", ft, 0), ("b", bt, h)):
            u, dh, dx = w[f"u{d}"], np.zeros((h, ids.shape[1]), np.float32), np.empty((len(ids), 3 * h, ids.shape[1]), np.float32)
            for t, z, r, cand, gh, before in reversed(tape):
                dh = dh + back[t, lo : lo + h]
                dc = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (before - cand) * z * (1 - z)
                dr = dc * gh * r * (1 - r)
                dx[t, :h], dx[t, h : 2 * h], dx[t, 2 * h :] = dz, dr, dc
                dg = np.concatenate([dz, dr, dc * r])
                g[f"u{d}"] += dg @ before.T
                dh = dh * z + u.T @ dg
            for k in range(3 * h):
                g[f"x{d}"][k] = np.bincount(flat, dx[:, k].ravel(), 256)
        return loss, g

    def fit(self, ids: np.ndarray, label: np.ndarray, weight: np.ndarray, *, rounds: int, batch: int = 256, rate: float = 0.02, seed: int = 9, text: np.ndarray | None = None) -> float:
        """Adam with a falling rate over so many batches of windows (time, window); the last batches' mean loss.

        text: the number of each window's text (in order). Batches draw a text, then any window of it, so a long text doesn't outweigh the others.
        """
        r = np.random.default_rng(seed)
        first = None if text is None else np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
        size = None if text is None else np.diff(np.append(first, len(text)))
        m, v, losses = {k: 0 for k in self.w}, {k: 0 for k in self.w}, []
        for i in range(1, rounds + 1):
            if text is None:
                pick = r.integers(0, ids.shape[1], batch)
            else:
                one = r.integers(0, len(first), batch)
                pick = first[one] + (r.random(batch) * size[one]).astype(np.int64)
            loss, g = self.gradients(ids[:, pick], label[pick], weight[:, pick].astype(np.float32))
            self._step(g, m, v, i, rate * (1 - 0.9 * i / rounds))
            losses.append(loss)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def _step(self, g: dict, m: dict, v: dict, i: int, rate: float) -> None:
        norm = sum(float((x * x).sum()) for x in g.values()) ** 0.5
        for k in self.w:
            x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)

    def go_through(self, ids: np.ndarray, label: np.ndarray, solid: np.ndarray, weight: np.ndarray, *, batch: int = 512, rate: float = 0.004, seed: int = 13) -> None:
        """Adam with a falling rate over batches of all windows (time, window), each once, in an order by chance. weight: of each window."""
        order, m, v = np.random.default_rng(seed).permutation(ids.shape[1]), {k: 0 for k in self.w}, {k: 0 for k in self.w}
        rounds = -(-len(order) // batch)
        for i in range(1, rounds + 1):
            pick = order[(i - 1) * batch : i * batch]
            _, g = self.gradients(ids[:, pick], label[pick], solid[:, pick] * weight[pick].astype(np.float32))
            self._step(g, m, v, i, rate * (1 - 0.9 * i / rounds))


def cut(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (time, window) of all texts, padded with spaces; the row of each; which bytes are letters."""
    n = -(-np.diff(offs) // width)
    row = np.repeat(np.arange(len(n)), n)
    start = offs[:-1][row] + width * ranges(np.zeros(len(n), np.int64), n)
    at = start[None, :] + np.arange(width)[:, None]
    inside = at < offs[1:][row][None, :]
    ids = np.where(inside, buf[np.minimum(at, max(len(buf) - 1, 0))], np.uint8(32)) if len(buf) else np.zeros((width, 0), np.uint8)
    return ids, row, _LETTER[ids] & inside


def document_scores(model: BiGru, buf: np.ndarray, offs: np.ndarray, width: int, batch: int = 1024) -> np.ndarray:
    """Probabilities (row, label); nought for a text without letters."""
    total, letters = np.zeros((len(offs) - 1, len(model.labels))), np.zeros(len(offs) - 1)
    ids, row, solid = cut(buf, offs, width)
    for i in range(0, len(row), batch):
        part = row[i : i + batch]
        some = solid[:, i : i + batch]
        sums = (model.log_probs(ids[:, i : i + batch]) * some[:, None, :]).sum(axis=0, dtype=np.float64)
        for k in range(len(model.labels)):
            total[:, k] += np.bincount(part, sums[k], len(total))
        letters += np.bincount(part, some.sum(axis=0), len(total))
    mean = total / np.maximum(letters, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True)) if total.size else mean
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    p[letters == 0] = 0
    return p


def sample(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, most_docs: int, seed: int = 3) -> list[tuple[str, str]]:
    """At most about most_docs (label, whole text) pairs, as many of each label as there are, drawn by a hash of id and text.

    Of equal pairs of label and text one is drawn.
    """
    two = docs.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    counts = {r["label"]: r["count"] for r in two.groupBy("label").count().collect()}
    if not counts:
        return []
    each = max(1, most_docs // len(counts))
    # a share of each label that gives a bit more than wanted, then the least hashes
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 1.3 * each / n + 20 / n))).otherwise(share)
    drawn = two.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    rows = drawn.orderBy("h", "label").limit(2 * most_docs + 100).select("label", "text").collect()
    out, held, seen = [], dict.fromkeys(counts, 0), set()
    for r in rows:
        pair = (r["label"], r["text"])
        if held[r["label"]] < each and pair not in seen:
            held[r["label"]] += 1
            seen.add(pair)
            out.append(pair)
    return out


def train(pairs: list[tuple[str, str]], *, width: int = 64, hidden: int = 8, rounds: int = 300, labels: list[str] | None = None) -> BiGru | None:
    """A network from (label, text) pairs, all windows of whole texts; None without pairs. labels: more than those of the pairs."""
    if not pairs:
        return None
    labels = labels or sorted({a for a, _ in pairs})
    raw = [t.encode() for _, t in pairs]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, row, letters = cut(buf, offs, width)
    model = BiGru(labels, hidden)
    model.fit(ids, np.array([labels.index(a) for a, _ in pairs])[row], letters, rounds=rounds, text=row)
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most_docs: int = 1200, **options) -> BiGru | None:
    """A network trained on the whole texts of at most about most_docs documents with a label, each label as often as there are documents for it."""
    return train(sample(docs, id_col=id_col, text_col=text_col, label_col=label_col, most_docs=most_docs), **options)


def _dealt(docs: DataFrame, text_col: str, label_col: str, share: int) -> tuple[DataFrame | None, dict[str, int]]:
    """(part, label, text) of every distinct pair of label and text, of about so many bytes a part; rows of each label.

    A part is in one task, in an order of its own, whatever the order and the partitions of docs.
    """
    two = docs.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    sums = two.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not sums:
        return None, {}
    parts = -(-sum(r["bytes"] for r in sums) // share)
    rows = two.distinct().withColumn("h", F.xxhash64(F.lit(11), "text", "label")).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "h", "label", "text")
    return rows.select("part", "label", "text"), {r["label"]: r["n"] for r in sums}


def _parts(batches):
    """(label, text) pairs of each part of a task."""
    part, pairs = None, []
    for batch in batches:
        for p, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if pairs:
                    yield pairs
                    give_back()
                part, pairs = p, []
            pairs.append((label, text))
    if pairs:
        yield pairs
    del pairs
    give_back()


def learn_part(model: BiGru, pairs: list[tuple[str, str]], weight: dict[str, float], width: int = 64, most: int = 1 << 19) -> None:
    """One pass through all windows of the pairs' whole texts. A text has the weight of its label, shared by its windows."""
    cuts, lo, total = [], 0, 0
    raw = [t.encode() for _, t in pairs]
    for i, x in enumerate(raw):
        total += len(x)
        if total >= most or i == len(raw) - 1:
            one = raw[lo : i + 1]
            ids, row, solid = cut(np.frombuffer(b"".join(one), np.uint8), np.concatenate([[0], np.cumsum([len(y) for y in one])]), width)
            cuts.append((ids, row + lo, solid))
            lo, total = i + 1, 0
    ids, row, solid = (np.concatenate(x, axis=-1) for x in zip(*cuts, strict=True))
    share = np.array([weight[a] for a, _ in pairs]) / np.bincount(row, minlength=len(pairs))
    model.go_through(ids, np.array([model.labels.index(a) for a, _ in pairs])[row], solid, share[row] / share[row].mean())


def fit_all(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most_docs: int = 1200, **options) -> BiGru | None:
    """A network trained on the whole texts of all documents with a label; None without any.

    It starts from a network of a sample as fit() has it. All distinct pairs of label and text are then
    dealt to learners by a hash; each goes once through all windows of its texts from that start, and
    the learners' weights are averaged by their numbers of texts. Labels have the weights that they
    have in the sample. The order of rows, their partitions and repeated rows don't change the network,
    but the rows' bytes give the number of learners.
    """
    rows, counts = _dealt(docs, text_col, label_col, LEARNER_BYTES)
    if rows is None:
        return None
    model = train(sample(docs, id_col=id_col, text_col=text_col, label_col=label_col, most_docs=most_docs), labels=sorted(counts), **options)
    each = max(1, most_docs // len(counts))
    weight, width = {a: min(n, each) / n for a, n in counts.items()}, options.get("width", 64)
    held = docs.sparkSession.sparkContext.broadcast((model, weight))

    def run(batches):
        for pairs in _parts(batches):
            start, by_label = held.value
            own = BiGru(start.labels, start.hidden)
            own.w = dict(start.w)
            learn_part(own, pairs, by_label, width)
            flat = np.concatenate([own.w[k].ravel() for k in sorted(own.w)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([len(pairs)]), pa.array([np.rint(flat * FIXED).astype(np.int64) * len(pairs)], pa.list_(pa.int64()))], names=["n", "w"])

    learnt = rows.mapInArrow(run, "n bigint, w array<bigint>").select("n", F.posexplode("w").alias("at", "w"))
    sums = learnt.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("w").cast("decimal(38,0)")).alias("w")).collect()
    flat = np.zeros(len(sums))
    for r in sums:
        flat[r["at"]] = int(r["w"]) / (r["n"] * FIXED)
    at = 0
    for k in sorted(model.w):
        size = model.w[k].size
        model.w[k] = flat[at : at + size].reshape(model.w[k].shape).astype(np.float32)
        at += size
    return model


def label_slice(model: BiGru | None, buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a slice."""
    n = len(offs) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    p = document_scores(model, buf, offs, width)
    best, score = p.argmax(axis=1), p.max(axis=1)
    label = [model.labels[b] if s > 0 else UNKNOWN for b, s in zip(best.tolist(), score.tolist(), strict=True)]
    # bytes beyond ASCII need not be letters
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 0x80))])
    for i in np.flatnonzero((score > 0) & (np.diff(letters[offs]) == 0)).tolist():
        if not any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")):
            label[i], score[i] = UNKNOWN, 0.0
    return label, score


def predict(docs: DataFrame, model: BiGru | None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", width: int = 64) -> DataFrame:
    """<id_col>, lang_pred (string), score (double, 0 to 1) of every row, from its whole text.

    A null text and one without a letter are `und` with a score of 0, and so is every row if there
    is no model. Of equal probabilities the label first in order wins. Repeated rows get equal
    results; an empty table gives no rows. Only the two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                label, score = label_slice(held.value, buf, offs, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(label, pa.string()), pa.array(score)], names=["key", "label", "score"])

    two = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    out = two.mapInArrow(run, f"key {kind}, label string, score double")
    return out.select(F.col("key").alias(id_col), F.col("label").alias(lang_col), F.col("score").alias(score_col))


def _letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes of letters in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(_LETTER[buf])])[offs])


def _size_class(letters: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(letters, 1)).astype(np.int64)


def _pieces(text: str, pieces: int, seed: int) -> list[str]:
    """The text and so many pieces of it of each length that is a power of two; the same for equal texts."""
    r, out = np.random.default_rng([seed, zlib.crc32(text.encode())]), [text]
    for n in (1 << k for k in range(1, len(text).bit_length())):
        m = len(text) - n + 1
        out += [text[i : i + n] for i in r.choice(m, min(m, pieces), replace=False).tolist()]
    return out


def least_by_size(model: BiGru, texts, *, pieces: int = 4, width: int = 64, seed: int = 6, most: int = 1 << 19) -> dict[int, tuple[int, float]]:
    """Texts and pieces of texts of each size (the logarithm of its letters) that have a score: their number, and the least score."""
    out, raw, total = {}, [], 0

    def score():
        buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        found, size = document_scores(model, buf, offs, width).max(axis=1), _size_class(_letters(buf, offs))
        for k in np.unique(size[found > 0]).tolist():
            here = found[(size == k) & (found > 0)]
            n, low = out.get(k, (0, 1.0))
            out[k] = n + len(here), min(low, float(here.min()))

    for text in texts:
        for x in _pieces(text, pieces, seed):
            raw.append(x.encode())
            total += len(raw[-1])
            if total >= most:
                score()
                raw, total = [], 0
    if raw:
        score()
    return out


def floors_from(seen: dict[int, tuple[int, float]], *, least: int = 1000, margin: float = 2.0) -> np.ndarray:
    """A score that texts in a language reach, by size: the least one seen, with its odds divided by a margin.

    A short text scores lower than a long one, so pieces of all lengths count, drawn from each text,
    with the whole text. A size with fewer of them than that takes the next smaller sizes in, and
    asks for no more than a larger one. Without texts nothing is asked for.
    """
    if not seen:
        return np.zeros(1)
    out = np.ones(max(seen) + 1)
    for k in range(len(out)):
        many, low = 0, 1.0
        for j in range(k, -1, -1):
            n, score = seen.get(j, (0, 1.0))
            many, low = many + n, min(low, score)
            if many >= least:
                break
        odds = low / max(1 - low, 1e-12) / margin if many else 0.0
        out[k] = odds / (1 + odds)
    return np.minimum.accumulate(out[::-1])[::-1]


def floors(docs: DataFrame, model: BiGru | None, *, text_col: str = "text", label_col: str = "lang", width: int = 64, **options) -> np.ndarray:
    """floors_from() the whole texts of all documents with a label, which the network should not have been trained on; equal ones count once."""
    rows, _ = _dealt(docs, text_col, label_col, FLOOR_BYTES)
    if model is None or rows is None:
        return np.zeros(1)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pairs in _parts(batches):
            seen = least_by_size(held.value, [t for _, t in pairs], width=width)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([x for _, x in seen.values()], pa.float64())], names=["size", "n", "least"])

    found = rows.mapInArrow(run, "size int, n bigint, least double").groupBy("size").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect()
    return floors_from({r["size"]: (r["n"], r["least"]) for r in found}, **options)


def keep_languages(docs: DataFrame, model: BiGru | None, *, text_col: str = "text", wanted: tuple[str, ...] | None = None, floors: np.ndarray | None = None, width: int = 64) -> DataFrame:
    """The rows whose text is in one of the wanted languages (any if None), all columns as they were.

    `und` is no language, so rows with a null text or without a letter go, and without a model all.
    With floors() a text that scores under the floor of its size is in no language either.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    least = np.zeros(1) if floors is None else floors

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(at)):
                label, score = label_slice(held.value, buf, offs, width)
                sure = score >= least[np.minimum(_size_class(_letters(buf, offs)), len(least) - 1)]
                yield batch.slice(lo, hi - lo).filter(pa.array([x != UNKNOWN and ok and (wanted is None or x in wanted) for x, ok in zip(label, sure.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
