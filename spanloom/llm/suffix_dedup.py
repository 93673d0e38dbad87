"""Substring dedup by prefix-partitioned suffix trees.

A repeat is a sequence of `window` words that starts in two documents. Texts are put into chunks of
about a MB, written once. Of all suffixes only those around anchors are dealt out: an anchor is the
k-word sequence with the least hash among those of a window, so equal windows have equal anchors,
wherever they stand. Three steps:

1. Each chunk sends its distinct anchors with the number of their windows, dealt by hash; those of
   one chunk alone can start no repeat between chunks and go no further.
2. Each chunk sends the words around its other anchors, each content once: suffixes that start at
   the anchor's windows and reach to the last of them, so most are longer than a window. They are
   dealt by a prefix: as a rule the anchor's k words. Where an anchor has more suffixes than fit a
   group, each goes by its own first words instead, and that prefix grows word by word, as long as
   so many suffixes share it; those that share a whole window need no tree, only their least
   document. In a group suffixes are sorted, the common lengths of neighbours give the suffix tree,
   and its internal nodes at the depth of a window or more are the repeats. For each suffix the
   deepest node that a lesser document is under says how many words repeat from there on.
3. Each chunk hears from which of its words how many are in a lesser document elsewhere, adds what
   repeats within itself, and drops the words that these windows cover.

Hashes only say what to compare; words decide. Answers come back by place, not by hash.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import join_on, written
from .textbuf import Packed, buffers, joined, mix, ranges, sequence_hash, windows, words

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 1 << 20
#: Anchors for each task of step 2, about, and the least number of tasks.
TASK_ANCHORS, LEAST_TASKS = 250_000, 64
#: Suffixes that a prefix may have before it grows: a group holds 84 bytes and some copies of each.
GROUP_SUFFIXES = 500_000
#: The id of rows without one.
NO_ID = np.iinfo(np.int64).max


def _pack(ids: list[pa.Array], texts: list[pa.Array]) -> bytes:
    sink = io.BytesIO()
    rows = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(texts)], names=["id", "text"])
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return sink.getvalue()


def _unpack(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.BufferReader(blob)) as r:
        return r.read_next_batch()


def _chunker(size: int):
    def run(batches):
        part, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([sum(map(len, ids))]), pa.array([held]), pa.array([_pack(ids, texts)], pa.binary())], names=["chunk", "n", "size", "blob"])

        for batch in batches:
            key, text = batch.column(0), batch.column(1).fill_null("")
            _, offs = buffers(text)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size - held, side="right")) - 1)
                ids.append(key.slice(lo, hi - lo))
                texts.append(pa.concat_arrays([text.slice(lo, hi - lo)]))
                held += int(offs[hi] - offs[lo])
                if held >= size or hi < len(text):
                    yield row()
                    made, ids, texts, held = made + 1, [], [], 0
                lo = hi
        if ids:
            yield row()

    return run


class Chunk:
    """A chunk's texts as words with exact numbers. row: each word's text. at: where windows start, win: their exact numbers."""

    def __init__(self, blob, window: int):
        rows = _unpack(blob)
        self.ids = rows.column("id")
        self.buf, offs = buffers(rows.column("text"))
        self.start, self.end, self.first = words(self.buf, offs)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.first))
        word = Packed.of(self.buf, self.start, self.end)
        self.hash, self.number = word.hash, word.numbers()
        self.id = self.ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.at, self.win = windows(self.number, self.row, window, self.hash)

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window its anchor's word, and the hashes of all k-word sequences."""
        grams = sequence_hash(self.hash, k)
        least, where = grams.copy(), np.arange(len(grams))
        for step in range(1, window - k + 1):  # the last of the least ones
            here = grams[step:]
            better = here <= least[: len(here)]
            least[: len(here)][better] = here[better]
            where[: len(here)][better] = np.arange(step, len(grams))[better]
        return where[self.at], grams

    def text(self, start: np.ndarray, length: np.ndarray) -> bytes:
        """So many words from each start, all with a space after them."""
        w = ranges(start, length)
        size = self.end[w] - self.start[w] + 1
        data = np.concatenate([self.buf, np.array([32], np.uint8)])[ranges(self.start[w], size)]
        data[np.cumsum(size) - 1] = 32
        return data.tobytes()


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal numbers; none of no numbers."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return first, np.append(first[1:], len(sorted_))


def _anchor_rows(window: int, k: int, tasks: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                c = Chunk(blob.as_buffer(), window)
                where, grams = c.anchors(window, k)
                h, n = np.unique(grams[where], return_counts=True)
                task = (h >> np.uint64(33)) % np.uint64(tasks)
                order = np.argsort(task, kind="stable")
                h, n, task = h[order], n[order].astype(np.uint32), task[order].astype(np.int64)
                cut, ends = _runs(task)
                yield pa.RecordBatch.from_arrays([pa.array(task[cut]), pa.array(np.full(len(cut), chunk)), *(pa.array([v[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for v in (h, n))], names=["task", "chunk", "anchors", "windows"])

    return run


def _numbers(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's numbers end to end, and each row's count of them."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def _by_chunk(chunk: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Rows of chunk and the bytes of its values."""
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    cut, ends = _runs(chunk)
    columns = [pa.array([v[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for v in (v[order] for v in values)]
    return pa.Table.from_arrays([pa.array(chunk[cut].astype(np.int64)), *columns], names=["chunk", *"vw"[: len(values)]])


def _shared_anchors(most: int):
    """Anchors of two chunks or more, for each of their chunks, with whether they have too many windows for a group."""

    def run(table: pa.Table) -> pa.Table:
        h, n = _numbers(table.column("anchors"), np.uint64)
        count, _ = _numbers(table.column("windows"), np.uint32)
        chunk = np.repeat(table.column("chunk").to_numpy(), n)
        if not len(h):
            return _by_chunk(chunk, h, np.zeros(0, np.uint8))
        _, back, chunks = np.unique(h, return_inverse=True, return_counts=True)
        more = chunks[back] > 1
        hot = np.bincount(back, count)[back] > most
        return _by_chunk(chunk[more], h[more], hot[more].astype(np.uint8))

    return run


def _records(c: Chunk, shared, window: int, k: int, hot: bool):
    """Start, length in words, windows and anchor's hash of what is around the shared anchors (hot ones or the others), each content once with its least document."""
    known, _ = _numbers(shared.column("v"), np.uint64)
    many, _ = _numbers(shared.column("w"), np.uint8)
    known = np.unique(known[many == hot])
    none = np.zeros(0, np.int64)
    where, grams = c.anchors(window, k)
    if not len(where) or not len(known):
        return none, none, none, none.astype(np.uint64)
    h = grams[where]
    ok = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
    p, a, h, win = c.at[ok], where[ok], h[ok], c.win[ok]
    if not len(p):
        return none, none, none, none.astype(np.uint64)
    # neighbouring windows of one anchor are a run
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(a) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p)))
    last = first + size - 1
    if hot:  # each window is the start of a suffix that reaches to the run's end
        last = np.repeat(last, size)
        first = np.arange(len(p))
        size = last - first + 1
    # equal runs: equal first and last windows, which overlap, and so many in all
    doc = c.id[c.row[p[first]]]
    order = np.lexsort((doc, size, win[last], win[first]))
    x, y, z = win[first][order], win[last][order], size[order]
    one = np.ones(len(order), bool)
    one[1:] = (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(z) != 0)
    keep = order[one]
    return p[first[keep]], size[keep] + window - 1, size[keep], h[first[keep]]


def _record_rows(window: int, k: int, tasks: int):
    """The words around shared anchors, by task."""

    def run(chunks: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        for chunk, blob in zip(chunks.column("chunk").to_pylist(), chunks.column("blob"), strict=True):
            c = Chunk(blob.as_buffer(), window)
            start, length, _, h = _records(c, shared, window, k, False)
            grp = ((h >> np.uint64(33)) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            cut, ends = _runs(grp[order])
            for x, y in zip(cut.tolist(), ends.tolist(), strict=True):
                r = order[x:y]
                out.append((int(grp[r[0]]), chunk, c.text(start[r], length[r]), length[r].astype(np.uint16).tobytes(), c.id[c.row[start[r]]].tobytes(), start[r].astype(np.uint32).tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[2:])], names=["grp", "chunk", "words", "lengths", "docs", "places"])

    return run


def _suffix_rows(window: int, k: int):
    """The suffixes of hot anchors' windows, a row each, with the hashes of their first k to window words and these words."""

    def run(chunks: pa.Table, shared: pa.Table) -> pa.Table:
        parts = []
        for chunk, blob in zip(chunks.column("chunk").to_pylist(), chunks.column("blob"), strict=True):
            c = Chunk(blob.as_buffer(), window)
            start, length, _, _ = _records(c, shared, window, k, True)
            n = len(start)
            prefix = np.stack([mix(sequence_hash(c.hash, m)[start] + np.uint64(m)) for m in range(k, window + 1)], 1).view(np.int64) if n else np.zeros((0, window - k + 1), np.int64)
            one = lambda m: [c.text(start[i : i + 1], m[i : i + 1]) for i in range(n)]
            parts.append(
                pa.Table.from_arrays(
                    [
                        pa.array(list(prefix), pa.list_(pa.int64())),
                        pa.array(np.full(n, chunk)),
                        pa.array(one(np.full(n, window)), pa.binary()),
                        pa.array(one(length), pa.binary()),
                        pa.array([x.tobytes() for x in length.astype(np.uint16)], pa.binary()),
                        pa.array(c.id[c.row[start]] if n else np.zeros(0, np.int64)),
                        pa.array(start),
                    ],
                    names=["prefixes", "chunk", "head", "words", "lengths", "doc", "place"],
                )
            )
        return pa.concat_tables(parts)

    return run


def common_lengths(rows: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """How many first items each sorted row shares with the row before it (0 for the first); length: the items that a row has."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        if length is not None:
            out[1:] = np.minimum(out[1:], np.minimum(length[1:], length[:-1]))
    return out


def deep_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end leaf of the suffix tree's uppermost internal nodes of at least that depth.

    Leaves are sorted suffixes; a node is a longest run of leaves whose neighbours share as many items.
    """
    deep = np.concatenate([lcp >= depth, [False]])
    first = np.flatnonzero(~deep[:-1] & deep[1:])
    end = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    return first, end


def tree_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First leaf, end leaf and depth of all internal nodes of at least that depth, upper ones first."""
    out = [np.zeros((3, 0), np.int64)]
    for d in range(depth, int(lcp.max()) + 1 if len(lcp) else 0):
        first, end = deep_nodes(lcp, d)
        if len(first):
            least = np.minimum.reduceat(np.append(lcp, 0), np.stack([first + 1, end], 1).ravel())[::2]
            here = least == d  # else the node lies deeper
            out.append(np.stack([first[here], end[here], np.full(int(here.sum()), d)]))
    first, end, d = np.concatenate(out, 1)
    return first, end, d


def repeated(suffix: np.ndarray, length: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each suffix (numbers of words, padded) how many of its first words a suffix of a lesser document has too: 0, or a window or more."""
    out = np.zeros(len(suffix), np.int64)
    order = np.argsort(np.ascontiguousarray(suffix.astype(">u4")).view(f"S{4 * suffix.shape[1]}").ravel(), kind="stable") if len(suffix) else out
    rows, size, owner = suffix[order], length[order], doc[order]
    for first, end, depth in zip(*_levels(common_lengths(rows, size), window), strict=True):
        leaf = ranges(first, end - first)
        least = np.repeat(np.minimum.reduceat(owner[leaf], np.cumsum(end - first) - (end - first)), end - first)
        gone = least < owner[leaf]
        out[order[leaf[gone]]] = np.repeat(depth, end - first)[gone]
    return out


def _levels(lcp: np.ndarray, window: int):
    """tree_nodes() by depth, upper ones first: lists of arrays."""
    first, end, depth = tree_nodes(lcp, window)
    at = [np.flatnonzero(depth == d) for d in np.unique(depth)]
    return [first[i] for i in at], [end[i] for i in at], [depth[i] for i in at]


def _suffixes(table: pa.Table, window: int):
    """Words' numbers, first word, length and document of all suffixes of a group's records, and the record and place of each."""
    data = b"".join(x.as_py() for x in table.column("words"))
    buf = np.frombuffer(data, np.uint8)
    start, end, _ = words(buf, np.array([0, len(buf)]))
    number = (Packed.of(buf, start, end).numbers() + 1).astype(np.uint32)
    length, records = _numbers(table.column("lengths"), np.uint16)
    length = length.astype(np.int64)
    n = length - window + 1
    begin = ranges(np.cumsum(length) - length, n)
    record = np.repeat(np.arange(len(length)), n)
    shift = begin - (np.cumsum(length) - length)[record]
    return number, begin, (length[record] - shift), record, shift, records


def _matrix(number: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    out = number[np.minimum(begin[:, None] + np.arange(width), max(len(number) - 1, 0))] if len(number) else np.zeros((0, width), np.uint32)
    out[np.arange(width) >= length[:, None]] = 0
    return out


def _trees(window: int, k: int):
    """For each chunk the words from which on words repeat in a lesser document (v), and how many of them (w)."""

    def run(table: pa.Table) -> pa.Table:
        number, begin, length, record, shift, records = _suffixes(table, window)
        doc, place = _numbers(table.column("docs"), np.int64)[0], _numbers(table.column("places"), np.uint32)[0]
        chunk = np.repeat(table.column("chunk").to_numpy(), records)
        found = repeated(_matrix(number, begin, length, 2 * window - k), length, doc[record], window)
        # a suffix says nothing new if the one before it in its record repeats for a word more
        told = np.zeros(len(found), bool)
        told[1:] = (record[1:] == record[:-1]) & (found[:-1] - 1 >= found[1:])
        at = np.flatnonzero((found > 0) & ~told)
        return _by_chunk(chunk[record[at]], (place[record[at]] + shift[at]).astype(np.uint32), found[at].astype(np.uint16))

    return run


def _hot_trees(window: int, k: int):
    """_trees() for rows of one suffix, of which only the start counts."""

    def run(table: pa.Table) -> pa.Table:
        number, begin, length, record, shift, _ = _suffixes(table, window)
        own = np.flatnonzero(shift == 0)
        doc, place, chunk = (table.column(c).to_numpy() for c in ("doc", "place", "chunk"))
        found = repeated(_matrix(number, begin[own], length[own], 2 * window - k), length[own], doc[record[own]], window)
        at = np.flatnonzero(found)
        r = record[own[at]]
        return _by_chunk(chunk[r], place[r].astype(np.uint32), found[at].astype(np.uint16))

    return run


_ANSWERS = "chunk bigint, v binary, w binary"


def _hot_repeats(suffixes: DataFrame, window: int, k: int) -> tuple[list[DataFrame], dict[int, int]]:
    """Answers for the suffixes of hot anchors, by prefixes that grow until a group fits, and the number of suffixes by length of prefix."""
    rest, out, used = suffixes, [], {}
    for m in range(k, window):
        rest = rest.withColumn("prefix", F.get("prefixes", F.lit(m - k)))
        counts = rest.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
        large = written(counts.filter(F.col("n") > GROUP_SUFFIXES).select("prefix"), "large")  # fewer than suffixes / GROUP_SUFFIXES
        fits = rest.join(large, "prefix", "left_anti")
        used[m] = fits.count()
        out.append(fits.groupBy("prefix").applyInArrow(_hot_trees(window, k), _ANSWERS))
        if large.isEmpty():
            return out, used
        rest = written(join_on(rest, large, ["prefix"], "left_semi"), "suffixes")
    # a whole window: its least document is a sum
    used[window] = rest.count()
    least = rest.groupBy("head").agg(F.min("doc").alias("least"))
    gone = join_on(rest, least, ["head"]).filter("least < doc")
    pack = lambda batches: (x for b in batches for x in _by_chunk(b.column("chunk").to_numpy(), b.column("place").to_numpy().astype(np.uint32), np.full(b.num_rows, window, np.uint16)).to_batches())
    out.append(gone.select("chunk", "place").mapInArrow(pack, _ANSWERS))
    return out, used


def _cutter(window: int, key: pa.DataType):
    place = pa.struct([("start", pa.int64()), ("n_words", pa.int64())])

    def run(chunks: pa.Table, gone: pa.Table) -> pa.Table:
        out = []
        for blob in chunks.column("blob"):
            c = Chunk(blob.as_buffer(), window)
            doc = c.id[c.row[c.at]]
            # windows that a lesser document of the same chunk has
            least = np.full(int(c.win.max()) + 1 if len(c.win) else 0, NO_ID)
            np.minimum.at(least, c.win, doc)
            # windows that repeat elsewhere, for the document that stands for their content and greater ones
            v, w = _numbers(gone.column("v"), np.uint32)[0].astype(np.int64), _numbers(gone.column("w"), np.uint16)[0].astype(np.int64)
            told = np.searchsorted(c.at, ranges(v, w - window + 1))
            from_ = np.full(len(least), NO_ID)
            away = np.zeros(len(least), bool)
            away[c.win[told]] = True
            np.minimum.at(from_, c.win[told], doc[told])
            starts = c.at[(least[c.win] < doc) | (away[c.win] & (doc >= from_[c.win]))]
            cover = np.zeros(len(c.number) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            covered = np.cumsum(cover[:-1]) > 0
            removed = np.zeros(len(c.number) + 1, np.int64)
            np.cumsum(covered, out=removed[1:])
            left = np.flatnonzero(~covered)
            raw, at = joined(c.buf, c.start[left], c.end[left], np.searchsorted(left, c.first))
            kept = [raw[a:b] for a, b in at]
            # runs of removed words of one text
            opens = covered.copy()
            opens[1:] &= ~(covered[:-1] & (c.row[1:] == c.row[:-1]))
            begin = np.flatnonzero(opens)
            size = np.diff(np.append(removed[begin], removed[-1]))
            cut = np.searchsorted(begin, c.first)
            repeats = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - c.first[c.row[begin]]), pa.array(size)], fields=list(place)))
            out.append(pa.Table.from_arrays([c.ids, pa.array(np.diff(c.first)), pa.array(np.diff(removed[c.first])), pa.array(kept, pa.binary()).cast(pa.string()), repeats], names=["key", "n_words", "n_removed", "kept", "repeats"]))
        return pa.concat_tables(out) if out else pa.table({"key": pa.array([], key), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "repeats": pa.array([], pa.list_(place))})

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """<id_col> (long), n_words, n_removed (long), kept (string) and repeats (array of start and n_words, in words) of every row.

    A word (a run of other characters than space and U+0009 to U+000D) goes if it lies in a window of
    so many words whose words also start in a row with a lesser id; kept is the others joined by one
    space, repeats the longest runs of words that go. A null or empty text, or one shorter than a
    window, loses nothing. Ids are integers; one that can't be read as such is null, and a null id
    counts as greater than all others and equal to other nulls. Repeated rows have equal ids, so
    neither loses to the other. An empty table gives no rows. Only the two named columns are read.
    """
    two = docs.select(F.col(id_col).try_cast("long").alias("key"), F.col(text_col).alias("text"))
    chunks = written(two.mapInArrow(_chunker(CHUNK_BYTES), "chunk bigint, n bigint, size bigint, blob binary"), "chunks")
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(LEAST_TASKS, total // 30 // TASK_ANCHORS)  # a word in 5 or 6 is an anchor
    blobs = chunks.select("chunk", "blob")
    anchors = blobs.mapInArrow(_anchor_rows(window, k, tasks), "task bigint, chunk bigint, anchors binary, windows binary")
    shared = written(anchors.groupBy("task").applyInArrow(_shared_anchors(GROUP_SUFFIXES), "chunk bigint, v binary, w binary"), "anchors")
    records = blobs.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_record_rows(window, k, tasks), "grp bigint, chunk bigint, words binary, lengths binary, docs binary, places binary")
    gone = written(records.groupBy("grp").applyInArrow(_trees(window, k), _ANSWERS), "repeats")
    hot = shared.filter(F.instr(F.hex("w"), "01") > 0)
    if not hot.isEmpty():
        suffixes = blobs.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInArrow(_suffix_rows(window, k), "prefixes array<bigint>, chunk bigint, head binary, words binary, lengths binary, doc bigint, place bigint")
        for more in _hot_repeats(written(suffixes, "suffixes"), window, k)[0]:
            gone = gone.unionByName(written(more, "repeats"))
    out = blobs.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_cutter(window, pa.int64()), "key bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:bigint,n_words:bigint>>")
    return out.withColumnRenamed("key", id_col)
