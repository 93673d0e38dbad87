"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Documents of equal words are one node. Each node's MinHash signature is cut into bands, as many and
as long as the threshold and the target recall ask for, and nodes that agree in a band fall into a
bucket. Each bucket pairs its members with its least one. Since that may be a stranger where many
texts share a passage, members of a bucket of three or more meet again in the buckets of two and of
three bands at once, which strangers rarely share. So candidates are linear in the nodes. What these
leave unconnected is compared exactly: in each bucket whose members are not all of one class by then,
all pairs of two classes, block by block, first by their signatures and then by their full sets. So
two nodes that agree in a band are always compared, or else connected already. A bucket has so many
blocks at most, and larger ones rather than more, so its rows grow with its nodes; only the
comparisons, which make no rows, grow with their square.

A candidate pair counts only when verified: signatures drop what is far off, then the full n-gram
sets, made of words and compared exactly, decide. Verified pairs connect nodes to classes. Links are
counted inside these classes alone, over all pairs: a class's sets go to tasks in blocks, a task gets
one block, or two blocks of sets whose sizes allow the similarity, and pairs are counted there and
never written. A link is lost only where two nodes are in no class together.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import join_on, written
from .textbuf import Packed, give_back, joined, sequence_hash, slices, windows, words

#: Sets and n-grams that a block holds at most, about; smaller groups are parted into so many blocks, but not into smaller ones than that.
BLOCK_SETS, BLOCK_GRAMS, BLOCKS, LEAST_BLOCK = 2048, 1_000_000, 16, 128
#: Signatures that a block of a crowded bucket holds, about, and its blocks at most; n-grams of a block above which it has more all the same, for their texts to fit a task.
SKETCHES, MOST_BLOCKS, MOST_GRAMS = 4096, 16, 20_000_000
#: Nodes whose texts are looked up by a broadcast of their keys, at most; more are joined by a shuffle.
FEW = 10_000


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold meets in one of them with that probability."""
    for rows in range(most_hashes, 0, -1):
        meet = threshold**rows
        bands = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding within so many hashes")


def gram_hashes(buf: np.ndarray, offs: np.ndarray, n: int):
    """For each text of a slice its words joined by spaces, and the sorted distinct hashes of its n-grams, which find candidates.

    A text of 1 to n - 1 words has one n-gram: all its words.
    """
    start, end, first = words(buf, offs)
    h = Packed.of(buf, start, end).hash
    grams = sequence_hash(h, n)
    raw, at = joined(buf, start, end, first)
    for a, b, (x, y) in zip(first[:-1].tolist(), first[1:].tolist(), at, strict=True):
        if b - a >= n:
            yield raw[x:y], np.unique(grams[a : b - n + 1])
        elif b > a:
            yield raw[x:y], sequence_hash(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield b"", grams[:0]


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text (words joined by spaces) the sorted numbers of its n-grams, equal in all of them for equal words alone."""
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, first = words(buf, offs)
    p, row = Packed.of(buf, start, end), np.repeat(np.arange(len(texts)), np.diff(first))
    at, gram = windows(p.numbers(), row, n, p.hash)
    many = int(gram.max()) + 1 if len(gram) else 1
    each = np.unique(row[at] * many + gram)
    cut = np.searchsorted(each, np.arange(len(texts) + 1) * many)
    short: dict[bytes, int] = {}
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if 0 < b - a < n:
            out.append(np.array([many + short.setdefault(texts[i], len(short))], np.int64))
        else:
            out.append(each[cut[i] : cut[i + 1]] - i * many)
    return out


def node_of(text: bytes) -> bytes | None:
    return hashlib.blake2b(text, digest_size=16).digest() if text else None


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = r.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.plus = r.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A bucket for each set and band, and the lowest byte of each of the set's least hashes; sets aren't empty."""
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        h = np.concatenate(sets)
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        low = np.empty((len(sets), self.bands * self.rows), np.uint64)
        for k in range(self.bands * self.rows):
            low[:, k] = np.minimum.reduceat(h * self.times[k] + self.plus[k], first)
        out = np.zeros((len(sets), self.bands), np.uint64)
        for j in range(self.rows):
            out = (out ^ low[:, j :: self.rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        mixed = low ^ (low >> np.uint64(8)) ^ (low >> np.uint64(16)) ^ (low >> np.uint64(24))
        return (out + np.arange(self.bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64), mixed.astype(np.uint8)


def block_count(sets, grams):
    """Blocks of a group, by its sets and n-grams (columns): so many that none is too large, and that a group is spread."""
    size = F.least(F.greatest(F.ceil(sets / BLOCKS), F.lit(min(LEAST_BLOCK, BLOCK_SETS))), F.lit(BLOCK_SETS))
    return F.ceil(F.greatest(sets / size, grams / BLOCK_GRAMS)).cast("int")


def bucket_blocks(sets, grams=None):
    """Blocks of a crowded bucket, by its sets, or by those and their n-grams where full texts are compared (columns)."""
    if grams is None:
        return F.least(F.ceil(sets / SKETCHES), F.lit(MOST_BLOCKS)).cast("int")
    return F.greatest(F.least(F.ceil(F.greatest(sets / BLOCK_SETS, grams / BLOCK_GRAMS)), F.lit(MOST_BLOCKS)), F.ceil(grams / MOST_GRAMS), F.lit(1)).cast("int")


def _block_tasks(node: str = "node"):
    """For a row of a bucket of so many blocks: its tasks, each of one block or two, with the side it is on."""
    i = F.pmod(F.xxhash64(node), "blocks").cast("int")
    to = lambda j: F.struct(F.concat_ws(":", "bucket", F.least(i, j), F.greatest(i, j)).alias("task"), (i > j).cast("int").alias("side"))
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), to)


def least_matches(hashes: int, threshold: float) -> int:
    """Equal bytes of two sketches below which a pair is far off: five deviations under what a pair at the threshold has."""
    return max(0, math.floor(hashes * threshold - 5 * math.sqrt(hashes * threshold * (1 - threshold))))


def _signer(n: int, bands: int, rows: int):
    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                texts, sets = zip(*gram_hashes(buf, offs, n), strict=True)
                full = [s for s in sets if len(s)]
                bucket, sketch = minhash.sign(full) if full else ([], [])
                got, seen = iter(list(bucket)), iter([x.tobytes() for x in sketch])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([node_of(t) for t in texts], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(got) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(seen) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["key", "at", "node", "size", "bands", "sketch"],
                )

    return run


def _words_of(batches):
    """Words of those rows whose text is that of the node they came for."""
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        for lo, hi, buf, offs in slices(batch.column("text")):
            start, end, first = words(buf, offs)
            raw, at = joined(buf, start, end, first)
            texts = [raw[a:b] for a, b in at]
            keep = [i for i in range(hi - lo) if node_of(texts[i]) == nodes[lo + i]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[lo + i] for i in keep], pa.binary()), pa.array([texts[i] for i in keep], pa.binary())], names=["node", "words"])


def _near(least: int):
    """Pairs whose sketches have so many equal bytes."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "other"))
                yield batch.select(["node", "pivot"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _tasks(batches, columns: tuple[str, ...]):
    """The rows of each run of one task, as columns."""
    task, rows = None, []
    for batch in batches:
        for t, *row in zip(*(batch.column(c).to_pylist() for c in ("task", *columns)), strict=True):
            if t != task:
                if rows:
                    yield list(zip(*rows, strict=True))
                task, rows = t, []
            rows.append(row)
        give_back()
    if rows:
        yield list(zip(*rows, strict=True))
    del rows
    give_back()


def _confirmer(n: int, threshold: float):
    """Pairs of a task's pivot (side 0) and its other nodes that are similar enough."""
    def run(batches):
        for node, side, text in _tasks(batches, ("node", "side", "words")):
            k = side.index(0)
            sets = gram_sets(list(text), n)
            yes = [i for i in range(len(node)) if side[i] and len(np.intersect1d(sets[i], sets[k], assume_unique=True)) >= threshold / (1 + threshold) * (len(sets[i]) + len(sets[k])) - 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in yes], pa.binary()), pa.array([node[k]] * len(yes), pa.binary())], names=["node", "pivot"])

    return run


def similar(sets: list[np.ndarray], side: np.ndarray, threshold: float):
    """Runs of rows of the upper half of a matrix, which says of each two sets whether they are linked: (first, end, rows).

    side: 0 and 1 for two blocks, of which only pairs across count; all 0 for one block.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(m), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    who, gram = who[order], gram[order]
    count = np.bincount(gram)
    begin = np.cumsum(count) - count
    common = count > max(16, m // 32)
    # n-grams of many sets as bits, by the word; of few sets as lists
    heavy = np.flatnonzero(common)
    slot = np.full(len(count), -1, np.int64)
    slot[heavy] = np.arange(len(heavy))
    bits = np.zeros((max(1, -(-len(heavy) // 64)), m), np.uint64)
    at = np.flatnonzero(common[gram])
    s = slot[gram[at]]
    np.bitwise_or.at(bits, (s // 64, who[at]), np.uint64(1) << (s % 64).astype(np.uint64))
    light = np.flatnonzero(~common & (count > 1))
    # each light n-gram's pairs, by its first partner: at distance d in its list
    pairs = []
    for d in range(1, int(count[light].max()) if len(light) else 0):
        g = light[count[light] > d]
        k = np.repeat(begin[g], count[g] - d) + np.concatenate([np.arange(x - d) for x in count[g].tolist()] or [np.zeros(0, np.int64)])
        pairs.append(who[k] * m + who[k + d])
    if pairs:
        pair, shared = np.unique(np.concatenate(pairs), return_counts=True)
    else:
        pair, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.searchsorted(pair, np.arange(m + 1) * m)
    step = max(1, (1 << 20) // m)
    two = bool(side.any())
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        both = np.zeros((hi - lo, m), np.int32)
        for w in bits if len(heavy) else []:
            both += np.bitwise_count(w[lo:hi, None] & w[None, :])
        p = pair[cut[lo] : cut[hi]] - lo * m
        both.ravel()[p] += shared[cut[lo] : cut[hi]].astype(np.int32)
        need = threshold / (1 + threshold) * (size[lo:hi, None] + size[None, :]) - 1e-9
        yes = both >= need
        yes &= np.arange(m)[None, :] > np.arange(lo, hi)[:, None]  # each pair once: the lists are sorted by row
        if two:
            yes &= side[lo:hi, None] != side[None, :]
        yield lo, hi, yes


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """For each set the copies of sets linked to it; see similar()."""
    links = np.zeros(len(sets), np.int64)
    for lo, hi, yes in similar(sets, side, threshold):
        links[lo:hi] += yes @ copies
        links += copies[lo:hi] @ yes
    return links


def bridges(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Linked pairs that connect all groups (a number for each set) that any linked pairs connect, fewer than there are groups."""
    root, out = group.copy(), []
    for lo, hi, yes in similar(sets, side, threshold):
        for i in range(lo, hi):
            for j in np.flatnonzero(yes[i - lo] & (root != root[i])).tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def _suspects(least: int):
    """Of a task's nodes those whose sketch has so many equal bytes with that of a node of another class."""
    def run(batches):
        for bucket, node, side, label, size, sketch in _tasks(batches, ("bucket", "node", "side", "label", "size", "sketch")):
            m, bits, side = len(node), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1), np.array(side)
            _, group, count = np.unique(np.array([x.hex() for x in label]), return_inverse=True, return_counts=True)
            found, two = np.zeros(m, bool), bool(side.any() and not side.all())
            # a pair of two classes has a node that isn't of the most frequent one
            for i in np.flatnonzero(group != count.argmax()).tolist():
                with_ = group != group[i]
                if two:
                    with_ &= side != side[i]
                at = np.flatnonzero(with_)
                at = at[(bits[at] == bits[i]).sum(axis=1) >= least]
                found[at] = True
                found[i] |= len(at) > 0
            yes = np.flatnonzero(found).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for i in yes], kind) for x, kind in ((bucket, pa.int64()), (node, pa.binary()), (label, pa.binary()), (size, pa.int64()))],
                names=["bucket", "node", "label", "size"],
            )

    return run


def chunks(size: np.ndarray, most_sets: int, most: int) -> list[tuple[int, int]]:
    """Runs of so many sets at most and, unless one alone has more, of so many n-grams: (first, end)."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and (i - lo == most_sets or total + n > most):
            out.append((lo, i))
            lo, total = i, 0
        total += n
    return [*out, (lo, len(size))] if len(size) else out


def _bridger(n: int, threshold: float, most_sets: int, most_grams: int):
    """bridges() of each task's nodes, of which two chunks are compared at once."""
    def run(batches):
        for node, side, label, size, text in _tasks(batches, ("node", "side", "label", "size", "words")):
            _, group = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
            side, size, found = np.array(side), np.array(size, np.int64), []
            parts = [[own[a:b] for a, b in chunks(size[own], most_sets, most_grams)] for own in (np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
            two = all(parts)
            pairs = [(a, b) for a in parts[0] for b in parts[1]] if two else [(a, b) for own in parts for k, a in enumerate(own) for b in own[k:]]
            for a, b in pairs:
                at = a if a is b else np.concatenate([a, b])
                if (group[at] == group[at[0]]).all():
                    continue
                apart = np.zeros(len(at), np.int64)
                if a is not b:
                    apart[len(a) :] = 1
                for i, j in bridges(gram_sets([text[k] for k in at.tolist()], n), group[at], apart, threshold):
                    found.append((at[i], at[j]))
                    group[group == group[at[j]]] = group[at[i]]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.binary()), pa.array([node[j] for _, j in found], pa.binary())], names=["node", "pivot"])

    return run


def _counter(n: int, threshold: float):
    def run(batches):
        for node, copies, side, text in _tasks(batches, ("node", "copies", "side", "words")):
            if len(node) > 1:
                links = linked(gram_sets(list(text), n), np.array(copies, np.int64), np.array(side, np.int64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links)], names=["node", "links"])

    return run


def _candidates(nodes: DataFrame, bands: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(node, pivot): what buckets pair and sketches don't rule out; (bucket, node) of buckets of three or more, whose other pairs are left to _rest()."""
    after = lambda k: F.get("bands", (F.col("j") + k) % bands)
    each = nodes.select("node", "bands", F.posexplode("bands").alias("j", "bucket")).select("node", "bucket", after(1).alias("b1"), after(2).alias("b2"))
    met = lambda rows: rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = written(join_on(each, met(each), ["bucket"]), "buckets")
    # a bucket of two has its only pair; larger ones are parted by the next bands
    crowd = one.filter("n > 2")
    found = one.filter("node > pivot").select("node", "pivot")
    for more in (["b1"], ["b1", "b2"]):
        again = crowd.select("node", F.xxhash64("bucket", *more).alias("bucket"))
        found = found.unionByName(again.join(met(again), "bucket").filter("node > pivot").select("node", "pivot"))
    pairs = written(found.distinct(), "pairs")
    sketches = nodes.select("node", "sketch")
    both = join_on(pairs, sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("other")), ["pivot"]).join(sketches, "node")
    return written(both.mapInArrow(_near(least), "node binary, pivot binary"), "near"), crowd.select("bucket", "node")


def _rest(crowd: DataFrame, label: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """bucket, node, label, size of what remains to be compared: nodes of a bucket with two classes or more that sketches don't rule out of being linked across them.

    A task is a block of a bucket, or two. A bucket's nodes come out once at most.
    """
    own = written(crowd.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "crowd")
    mixed = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), bucket_blocks(F.count(F.lit(1))).alias("blocks")).filter("x <> y").select("bucket", "blocks")
    dealt = join_on(own, mixed, ["bucket"]).join(nodes.select("node", "size", "sketch"), "node").select("bucket", "node", "label", "size", "sketch", F.explode(_block_tasks()).alias("x"))
    dealt = dealt.select("x.task", "x.side", "bucket", "node", "label", "size", "sketch")
    found = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_suspects(least), "bucket bigint, node binary, label binary, size bigint")
    return written(found.distinct(), "rest")


def _bridges(rest: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, pivot): pairs of what remains that are similar enough and connect classes."""
    blocks = rest.groupBy("bucket").agg(bucket_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    full = join_on(rest, blocks, ["bucket"]).join(texts, "node").select("node", "label", "size", "words", F.explode(_block_tasks()).alias("x"))
    full = full.select("x.task", "x.side", "node", "label", "size", "words")
    return written(full.repartition("task").sortWithinPartitions("task").mapInArrow(_bridger(n, threshold, BLOCK_SETS, BLOCK_GRAMS), "node binary, pivot binary"), "bridges")


def _texts(two: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    """node, words of the wanted nodes (node, key, at). few: they are sent to the rows, which stay where they are."""
    t, w = two.alias("t"), (F.broadcast(wanted) if few else wanted).alias("w")
    texts = t.join(w, F.col("t.key").eqNullSafe(F.col("w.key")) & F.col("t.at").eqNullSafe(F.col("w.at"))).select("w.node", "text").mapInArrow(_words_of, "node binary, words binary")
    return written(texts.dropDuplicates(["node"]), "texts")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs that are similar enough by their full sets. A pivot of many nodes has a task for each block of them."""
    pairs = written(pairs.join(nodes.select("node", "size"), "node"), "pairs")
    blocks = block_count(F.count(F.lit(1)), F.sum("size")).alias("blocks")
    dealt = join_on(pairs, pairs.groupBy("pivot").agg(blocks), ["pivot"]).select("node", "pivot", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    task = F.concat_ws(":", F.hex("pivot"), "block").alias("task")
    others = dealt.select(task, F.lit(1).alias("side"), "node")
    pivots = dealt.select("pivot", "block").distinct().select(task, F.lit(0).alias("side"), F.col("pivot").alias("node"))
    rows = others.unionByName(pivots).join(texts, "node").select("task", "side", "node", "words")
    return written(rows.repartition("task").sortWithinPartitions("task").mapInArrow(_confirmer(n, threshold), "node binary, pivot binary"), "confirmed")


def _links(classes: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, links: the copies of other nodes of its class that each node is linked to."""
    # blocks: small classes have one; else by size class, so that only neighbouring classes can be similar, and by hash
    members = written(classes.withColumnRenamed("label", "grp").join(nodes.select("node", "copies", "size"), "node").withColumn("cls", F.floor(F.log("size") / F.lit(-math.log(threshold)) + 1e-9)), "members")
    sums = members.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("grams"))
    whole = sums.groupBy("grp").agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams"), F.map_from_entries(F.collect_list(F.struct("cls", block_count(F.col("sets"), F.col("grams")).alias("blocks")))).alias("by"))
    whole = whole.withColumn("small", block_count(F.col("sets"), F.col("grams")) <= 1)
    placed = join_on(members, whole.select("grp", "small", "by"), ["grp"])
    number = lambda shift: F.coalesce(F.try_element_at("by", F.col("cls") + shift), F.lit(0)).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), number(0)).cast("int"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c, i, d, j: F.concat_ws(":", c, i, d, j)
    one = lambda key, side: F.struct(F.concat_ws(":", F.hex("grp"), key).alias("task"), side.cast("int").alias("side"))
    c, i = F.col("cls"), F.col("own")
    tasks = F.when(F.col("small"), F.array(one(F.lit("-"), F.lit(0)))).otherwise(
        F.concat(
            F.transform(upto(number(0)), lambda j: one(name(c, F.least(i, j), c, F.greatest(i, j)), i > j)),
            F.transform(upto(number(1)), lambda j: one(name(c, i, c + 1, j), F.lit(0))),
            F.transform(upto(number(-1)), lambda j: one(name(c - 1, j, c, i), F.lit(1))),
        )
    )
    dealt = placed.select("node", "copies", tasks.alias("tasks")).join(texts, "node").select("node", "copies", "words", F.explode("tasks").alias("x")).select("x.task", "x.side", "node", "copies", "words")
    found = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_counter(n, threshold), "node binary, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _classed(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): key, at (the text's hash) and node of every row; class_id, n_links and one, the row that stands for the class, of every node."""
    bands, rows = bands_for(threshold, recall)
    two = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    signed = written(two.mapInArrow(_signer(n, bands, rows), f"key {kind}, at bigint, node binary, size bigint, bands array<bigint>, sketch binary"), "signatures")
    nodes = written(
        signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.min(F.struct(F.col("key").isNull().alias("no"), "key", "at")).alias("one"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    least = least_matches(bands * rows, threshold)
    near, crowd = _candidates(nodes, bands, least)
    place = nodes.select("node", F.col("one.key").alias("key"), F.col("one.at").alias("at"))
    texts = _texts(two, near.select(F.explode(F.array("node", "pivot")).alias("node")).distinct().join(place, "node"))

    # each node with one pivot first; then only pairs that these don't connect
    sure = _confirmed(near.groupBy("node").agg(F.min("pivot").alias("pivot")), nodes, texts, n, threshold)
    label = written(components(sure, "node", "pivot"), "labels")
    own = near.join(label, "node", "left").withColumnRenamed("label", "x")
    apart = written(join_on(written(own, "own"), label.select(F.col("node").alias("pivot"), F.col("label").alias("y")), ["pivot"], "left").filter("coalesce(x, node) <> coalesce(y, pivot)").select("node", "pivot"), "apart")
    if not apart.isEmpty():
        sure = sure.unionByName(_confirmed(apart, nodes, texts, n, threshold))
        label = written(components(sure, "node", "pivot"), "labels")
    rest = _rest(crowd, label, nodes, least)
    missing = written(rest.select("node").distinct().join(texts.select("node"), "node", "left_anti").join(place, "node"), "missing")
    if not rest.isEmpty():
        if more := missing.count():
            texts = texts.unionByName(_texts(two, missing, few=more <= FEW))
        new = _bridges(rest, texts, n, threshold)
        if not new.isEmpty():
            label = written(components(sure.unionByName(new), "node", "pivot"), "labels")
    links = written(_links(label, nodes, texts, n, threshold), "links")
    known = nodes.select("node", "copies", "least", "one").join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"), F.min("one").alias("one"))
    final = known.drop("one").join(classes, "label").select("node", "class_id", "one", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("key", "at", "node"), final


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """<id_col>, class_id, n_links for every row.

    Two rows are linked if the Jaccard similarity of their sets of n-word sequences (words are runs
    of other characters than space and U+0009 to U+000D) is at least the threshold; class_id is the
    least id of all rows linked to a row directly or through others, n_links the number of rows
    linked to it directly. Texts of fewer than n words have one sequence, all their words; null
    texts and texts without a word are linked to none and have a class of their own. Repeated rows
    are linked to each other. Rows with a null id take part; a class of such rows alone has a null
    class_id. An empty table gives no rows. Only the two named columns are read.
    """
    signed, final = _classed(docs, id_col, text_col, n, threshold, recall)
    out = signed.select("key", "node").join(final, "node", "left")
    return out.select(F.col("key").alias(id_col), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows, with one row of each class of near duplicates: that with the class's least id.

    A null id counts as greater than all others. Of rows of the class with the same id one text is
    kept, that with the least hash, and of repeated rows (same id, same text) any one. Null texts
    and texts without a word are in no class and stay.
    """
    signed, final = _classed(docs, id_col, text_col, n, threshold, recall)
    rows = signed.filter(F.col("node").isNotNull()).join(final.select("node", "one"), "node")
    stays = F.col("key").eqNullSafe(F.col("one.key")) & (F.col("at") == F.col("one.at"))
    # rows of the same id and text are in the same class: either all go, or one stays
    marks = rows.groupBy(F.col("key").alias("__key"), F.col("at").alias("__at")).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("copies"))
    marks = written(marks.filter("NOT stays OR copies > 1"), "marks")
    row = docs.select(F.struct("*").alias("row"))
    key, at = F.col("row").getField(id_col), F.xxhash64(F.col("row").getField(text_col))
    same = key.eqNullSafe(F.col("__key")) & (at == F.col("__at"))
    left = row.join(marks, same, "left_anti")
    again = marks.filter("stays")
    if not again.isEmpty():
        left = left.unionByName(row.join(again, same).dropDuplicates(["__key", "__at"]).select("row"))
    return left.select("row.*")
