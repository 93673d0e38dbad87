"""Packing: concatenate and cut.

Pass 1 encodes every document and writes its ids with the number of ids before it in its partition.
The totals of the partitions (a row each) give, by a prefix sum, where each partition starts in the
one long sequence of all ids. Pass 2 cuts that sequence into fixed windows: a document becomes a
piece for each window that it reaches into. No rows are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import wordbpe
from .shared import written
from .textbuf import ranges


#: Partitions whose starts are sent to all executors, 16 bytes each; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1 << 20


def _encoder(spec, end_id: int):
    def run(batches):
        w, part, before = wordbpe.tokenizer(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, offs in w.encode(batch.column(1)):
                n = np.diff(offs) + 1
                all_ids = np.empty(len(ids) + hi - lo, np.uint32)
                ends = np.cumsum(n)
                last = np.zeros(len(all_ids), bool)
                last[ends - 1] = True
                all_ids[last] = end_id
                all_ids[~last] = ids
                at = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int64)),
                        pa.array(before + at[:-1]),
                        pa.array(n),
                        binary(all_ids.astype(np.uint16) if max(w.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else all_ids, at),
                    ],
                    names=["key", "part", "before", "n", "ids"],
                )
                before += int(ends[-1])

    return run


def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column from numbers end to end and each row's first of them."""
    size = values.dtype.itemsize
    if len(values) * size < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    data = values.tobytes()
    return pa.array([data[a * size : b * size] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def _cutter(window: int):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            first = col["first"].to_numpy(zero_copy_only=False)
            n = col["n"].to_numpy(zero_copy_only=False)
            seq = first // window
            pieces = (first + n - 1) // window - seq + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sid = ranges(seq, pieces)
            start = np.maximum(sid * window - first[row], 0)
            length = np.minimum((sid + 1) * window - first[row], n[row]) - start
            out = []
            for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                raw = col["ids"][r].as_buffer()
                size = len(raw) // int(n[r])
                out.append(np.frombuffer(raw, np.dtype(f"<u{size}"), m, s * size).astype("<u4").tobytes())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [col["key"].take(at), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(sid), pa.array(first[row] + start - sid * window), pa.array(out, pa.binary())],
                names=["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents in windows of so many ids.

    Returns <id_col>, start, length, doc_tokens, sequence_id, offset (long) and ids (binary: unsigned
    32-bit little-endian). A document is its ids followed by end_id, so a null or empty text is one
    id; each row is a document of its own, repeated rows and null keys included. All windows but the
    last are full. An empty table gives no rows. Only the two named columns are read, so others may
    have any names. The order of documents is that of the input's partitions.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(wordbpe.spec_of(tokenizer_path))
    two = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key = two.schema["key"].dataType.simpleString()
    coded = written(two.mapInArrow(_encoder(spec, end_id), f"key {key}, part bigint, before bigint, n bigint, ids binary"), "packed")
    # one row for each partition of the input, so its number is that of the driver's own tasks; it is sent to all only while it is small
    totals = sorted((r["part"], r["total"]) for r in coded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect())
    base = np.concatenate([[0], np.cumsum([t for _, t in totals], dtype=np.int64)])[: len(totals)].tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=True)], "part bigint, base bigint")
    if len(totals) <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    placed = coded.join(starts, "part").select("key", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    out = placed.mapInArrow(_cutter(window), f"key {key}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("key", id_col)
