"""BPE with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text where its low bits are nought, so equal
passages of different documents fall into equal chunks wherever they stand. Each Python worker
keeps the ids of the chunks it has met, by their bytes, in a bounded table, and encodes a chunk
only when it is not there. A cut may part a word, or any other unit of the tokenizer, so the ids at
both sides of each join are suspect. A join is repaired by encoding anew a window around it that
holds whole words of both chunks: if the window's outer words get the very ids that the chunks gave
them, its ids replace those between; if not, the window grows, up to both whole chunks.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordbpe
from .packing import binary
from .textbuf import SPACE, slices

#: Mean bytes between cuts: a power of two.
CHUNK_BYTES = 1024
#: Bytes without a candidate before a cut, so runs of one byte are not cut everywhere.
QUIET_BYTES = 64
#: A chunk has so many words at least, so that two joins never share a word.
LEAST_WORDS = 6
#: Bytes of chunks and ids that a Python worker keeps.
KEPT_BYTES = 64 << 20

_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(buf: np.ndarray) -> np.ndarray:
    """For each byte a hash of the 32 bytes that end there: the sum of their keys, older ones shifted left further."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(buf: np.ndarray, offs: np.ndarray, mean: int = CHUNK_BYTES) -> np.ndarray:
    """Where chunks start: at each text's start, and where its bytes say so."""
    if not len(buf):
        return offs[:-1]
    top = np.uint32(((mean - 1) << (32 - mean.bit_length() + 1)) & 0xFFFFFFFF)  # the high bits depend on all 32 bytes
    hit = np.flatnonzero((rolling(buf) & top) == 0) + 1
    hit = hit[hit < len(buf)]
    row = np.searchsorted(offs, hit, side="right") - 1
    hit = hit[hit - offs[row] >= 32]
    hit = hit[(buf[hit] & 0xC0) != 0x80]
    if len(hit):
        hit = hit[np.concatenate([[True], np.diff(hit) >= QUIET_BYTES])]
    return np.unique(np.concatenate([offs[:-1], hit]))


class Chunk:
    """Ids of a chunk by itself; words: start, end and number of ids before, with one more number."""

    __slots__ = ("data", "ids", "before", "start", "end")

    def __init__(self, data: bytes, ids: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray):
        self.data, self.ids, self.start, self.end, self.before = data, ids, start, end, before

    def size(self) -> int:
        return len(self.data) + self.ids.nbytes + 12 * len(self.start) + 300


class ChunkBpe:
    def __init__(self, spec: str, mean: int = CHUNK_BYTES, kept: int = KEPT_BYTES):
        self.word = wordbpe.tokenizer(spec)
        self.mean, self.most, self.size = mean, kept, 0
        self.kept: OrderedDict[bytes, Chunk] = OrderedDict()
        self.asked = self.made = self.grown = 0

    def _encode(self, parts: list[bytes]) -> list[Chunk]:
        """Each part by itself."""
        buf = np.frombuffer(b"".join(parts), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        ids, count, start, end = self.word.pieces(buf, offs)
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        # the pieces between white space are one word
        new = np.empty(len(start), bool)
        if len(start):
            new[0] = True
            new[1:] = start[1:] != end[:-1]
        new[np.searchsorted(start, offs[:-1][offs[:-1] < len(buf)])[np.isin(offs[:-1][offs[:-1] < len(buf)], start)]] = True
        head = np.flatnonzero(new)
        ws, we = start[head], end[np.concatenate([head[1:] - 1, [len(start) - 1]])] if len(head) else end[:0]
        wb = np.concatenate([before[head], before[-1:]])
        lo = np.searchsorted(ws, offs)
        out = []
        for i, part in enumerate(parts):
            a, b = lo[i], lo[i + 1]
            f, g = wb[a], wb[b]
            out.append(Chunk(part, ids[f:g].copy(), (ws[a:b] - offs[i]).astype(np.int32), (we[a:b] - offs[i]).astype(np.int32), (wb[a : b + 1] - f).astype(np.int32)))
        return out

    def chunks(self, parts: list[bytes]) -> list[Chunk]:
        """Each part's chunk, from the table or made now and kept."""
        got: dict[bytes, Chunk] = {}
        new: list[bytes] = []
        for p in dict.fromkeys(parts):
            if (c := self.kept.get(p)) is not None:
                self.kept.move_to_end(p)
                got[p] = c
            else:
                new.append(p)
        self.asked += len(parts)
        self.made += len(new)
        if new:
            for p, c in zip(new, self._encode(new), strict=True):
                got[p] = self.kept[p] = c
                self.size += c.size()
            while self.size > self.most:
                self.size -= self.kept.popitem(last=False)[1].size()
        return [got[p] for p in parts]

    def joins(self, left: list[Chunk], right: list[Chunk]) -> tuple[list[int], list[int], list[np.ndarray]]:
        """For each join: ids to keep of the left chunk, ids to drop of the right one, ids between."""
        n = len(left)
        keep, drop, between = [0] * n, [0] * n, [np.zeros(0, self.word.dtype)] * n
        todo, reach = list(range(n)), 2
        while todo:
            spans = [(max(0, len(left[i].start) - reach), min(len(right[i].start), reach)) for i in todo]
            windows = self._encode([left[i].data[left[i].start[a] if len(left[i].start) and a else 0 :] + right[i].data[: right[i].end[b - 1] if b and b < len(right[i].start) else len(right[i].data)] for i, (a, b) in zip(todo, spans, strict=True)])
            again = []
            for i, (a, b), w in zip(todo, spans, windows, strict=True):
                x, y = left[i], right[i]
                # the outer words, whole in a chunk and away from the join, must have got the same ids
                if a and b < len(y.start):
                    m, k = x.before[a + 1] - x.before[a], y.before[b] - y.before[b - 1]
                    agree = len(w.ids) >= m + k and (w.ids[:m] == x.ids[x.before[a] : x.before[a + 1]]).all() and (w.ids[len(w.ids) - k :] == y.ids[y.before[b - 1] : y.before[b]]).all()
                else:
                    agree = not a and b == len(y.start)  # both whole chunks
                if not agree:
                    again.append(i)
                    continue
                keep[i], drop[i], between[i] = int(x.before[a]), int(y.before[b]), w.ids
            self.grown += len(again)
            todo, reach = again, reach * 2 if reach * 2 < max([0, *(max(len(left[i].start), len(right[i].start)) for i in again)]) else 1 << 30
        return keep, drop, between

    def encode(self, texts: pa.Array):
        """(first row, end row, ids, n + 1 offsets of the rows' ids) for slices of a column."""
        for lo, hi, buf, offs in slices(texts):
            yield lo, hi, *self.word.apart(buf, offs, buf.tobytes(), self._slice)

    def _slice(self, buf: np.ndarray, offs: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([cuts(buf, offs, self.mean), [len(buf)]]).astype(np.int64)
        solid = ~SPACE[buf]
        begins = np.zeros(len(buf) + 1, np.int64)
        if len(buf):
            np.cumsum(solid & np.concatenate([[True], ~solid[:-1]]), out=begins[1:])
        # chunks of few words are joined to what follows, the last of a text to what precedes
        first = np.searchsorted(at, offs)
        parts: list[bytes] = []
        rows: list[tuple[int, int]] = []
        pos, have = at.tolist(), begins[at].tolist()
        for r in range(len(offs) - 1):
            a, b = int(first[r]), int(first[r + 1])
            own = [pos[a]]
            for j in range(a + 1, b):
                if have[j] - begins[own[-1]] >= LEAST_WORDS and have[b] - have[j] >= LEAST_WORDS:
                    own.append(pos[j])
            ends = [*own[1:], int(offs[r + 1])]
            rows.append((len(parts), len(parts) + len(own)))
            parts += [data[x:y] for x, y in zip(own, ends, strict=True)]
        got = self.chunks(parts)
        inner = [j for a, b in rows for j in range(a, b - 1)]
        keep, drop, between = self.joins([got[j] for j in inner], [got[j + 1] for j in inner])
        fix = dict(zip(inner, zip(keep, drop, between, strict=True), strict=True))
        out: list[np.ndarray] = [np.zeros(0, self.word.dtype)]
        size = np.zeros(len(rows) + 1, np.int64)
        for r, (a, b) in enumerate(rows):
            n = 0
            for j in range(a, b):
                lo = fix[j - 1][1] if j > a else 0
                hi = fix[j][0] if j + 1 < b else len(got[j].ids)
                if hi < lo:  # both joins took the whole chunk: nothing is known of it, so the text is encoded whole
                    break
                out.append(got[j].ids[lo:hi])
                n += hi - lo
                if j + 1 < b:
                    out.append(fix[j][2])
                    n += len(fix[j][2])
            else:
                size[r + 1] = n
                continue
            del out[len(out) - (2 * (j - a)) :]
            out.append(self.word.pieces(buf[offs[r] : offs[r + 1]], np.array([0, offs[r + 1] - offs[r]]))[0])
            size[r + 1] = len(out[-1])
        return np.concatenate(out), np.cumsum(size)


_made: dict[tuple, ChunkBpe] = {}


def chunk_tokenizer(spec: str, mean: int = CHUNK_BYTES) -> ChunkBpe:
    if (spec, mean) not in _made:
        _made.clear()
        _made[spec, mean] = ChunkBpe(spec, mean)
    return _made[spec, mean]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """<id_col>, n_tokens long, ids binary (unsigned 32-bit little-endian) of every row.

    A null or empty text has no ids. Rows stay in their partitions; repeated rows and null keys give
    a row each; an empty table gives none. Only the two named columns are read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(wordbpe.spec_of(tokenizer_path))

    def run(batches):
        enc = chunk_tokenizer(spec.value)
        for batch in batches:
            for lo, hi, ids, at in enc.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), binary(ids.astype("<u4"), at)], names=["key", "n_tokens", "ids"])

    two = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary").withColumnRenamed("key", id_col)


def decode(coded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """<id_col>, decoded string: the tokens of each row's ids (as encode() writes them) joined by one space, special ones kept.

    The vocabulary has no decoder, so this is what the library's decode() writes. A null counts as no ids.
    """
    spec = coded.sparkSession.sparkContext.broadcast(wordbpe.spec_of(tokenizer_path))

    def run(batches):
        tokens = wordbpe.tokenizer(spec.value).tokens()
        for batch in batches:
            texts = [" ".join([tokens[i] for i in np.frombuffer(raw, "<u4").tolist()]) if raw else "" for raw in (x.as_buffer() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    two = coded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", id_col)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the rows, with digests in place of both results."""
    spec = docs.sparkSession.sparkContext.broadcast(wordbpe.spec_of(tokenizer_path))

    def run(batches):
        enc = chunk_tokenizer(spec.value)
        tokens, numbers = enc.word.tokens(), [str(i) for i in range(enc.word.lib.get_vocab_size())]
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for batch in batches:
            for lo, hi, ids, at in enc.encode(batch.column(1)):
                rows = [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array([sha([numbers[i] for i in r]) for r in rows], pa.string()), pa.array([sha([tokens[i] for i in r]) for r in rows], pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    two = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)
