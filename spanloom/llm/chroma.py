"""Media columns: chroma fingerprints of audio, and the alignment of recordings.

Frames of a recording are folded onto the twelve pitch classes. Over the integral image of these
frames sixteen filters compare the sums of two areas; each difference is one of four levels, and
the sixteen levels are packed into an integer for each place. Recordings that share integers at one
and the same offset (the peak of the histogram of offsets) are aligned there, and the share of
unequal bits over their overlap decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import join_on, written
from .textbuf import mix, ranges

#: Samples a second, of a frame and between frames, and the lowest and highest pitch in Hz.
RATE, FRAME, HOP, LOW, HIGH = 4000, 1024, 256, 110.0, 1760.0
#: Frames that a filter spans at most.
SPAN = 8
#: Filters: how the area is parted, first pitch class, pitch classes, frames.
FILTERS = (
    ("time", 0, 3, 8), ("time", 3, 3, 8), ("time", 6, 3, 8), ("time", 9, 3, 8),
    ("pitch", 0, 4, 4), ("pitch", 4, 4, 4), ("pitch", 8, 4, 4), ("pitch", 0, 12, 8),
    ("cross", 0, 4, 6), ("cross", 4, 4, 6), ("cross", 8, 4, 6), ("cross", 2, 8, 8),
    ("band", 0, 6, 4), ("band", 6, 6, 4), ("band", 3, 6, 8), ("beat", 0, 12, 6),
)
#: Where the levels of a filter's difference (of logarithms) part, by kind.
LEVELS = {"time": 0.3, "pitch": 0.45, "cross": 0.25, "band": 0.4, "beat": 0.02}
#: Levels as two bits of which neighbours differ in one.
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def pcm16(value) -> np.ndarray:
    """Samples of a binary value: signed 16-bit little-endian, one channel, at RATE."""
    return np.frombuffer(value, "<i2", len(value) // 2).astype(np.float32) / 32768


def _bins() -> tuple[np.ndarray, np.ndarray]:
    """The spectrum's bins between LOW and HIGH, by pitch class, and where each class starts among them."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero((f >= LOW) & (f <= HIGH))
    pitch = np.round(12 * np.log2(f[use] / 440)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    return use[order], np.searchsorted(pitch[order], np.arange(12))


(_BINS, _FIRST), _WINDOW = _bins(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, block: int = 32) -> np.ndarray:
    """(frame, pitch class): magnitudes by pitch class, each frame of unit length, silence of noughts."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    out = np.empty((n, 12), np.float32)
    for i in range(0, n, block):  # few at a time stay in the processor's cache
        out[i : i + block] = np.add.reduceat(np.abs(np.fft.rfft(frames[i : i + block] * _WINDOW, axis=1)[:, _BINS]), _FIRST, axis=1)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def pack(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An integer for each place (frame from which the filters reach SPAN ahead), and whether anything sounds there."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    area = lambda t0, t1, p0, p1: image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]
    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        if kind == "time":
            a, b = area(0, w // 2, p, p + h), area(w // 2, w, p, p + h)
        elif kind == "pitch":
            a, b = area(0, w, p, p + h // 2), area(0, w, p + h // 2, p + h)
        elif kind == "cross":
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
            b = area(w // 2, w, p, p + h // 2) + area(0, w // 2, p + h // 2, p + h)
        elif kind == "band":
            a, b = area(0, w, p + h // 3, p + h - h // 3), area(0, w, p, p + h // 3) + area(0, w, p + h - h // 3, p + h)
        else:
            a, b = area(w // 3, w - w // 3, p, p + h), area(0, w // 3, p, p + h) + area(w - w // 3, w, p, p + h)
        d, t = np.log((a + 0.05) / (b + 0.05)), LEVELS[kind]
        if kind in ("band", "beat"):  # the second area is twice as large
            d += math.log(2)
        out = out << np.uint32(2) | _GRAY[(d > -t).astype(int) + (d > 0) + (d > t)]
    return out, area(0, SPAN, 0, 12) > 0


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pack(chroma(samples))


def fingerprints(rows: DataFrame, *, id_col: str, audio_col: str, decode: Callable[[object], np.ndarray] = pcm16, phases: int = 1) -> DataFrame:
    """<id_col>, n (places), code (binary: an unsigned 32-bit integer a place) and sounding (binary: a byte a place) of every row.

    decode makes samples of a value of audio_col. A null value, or fewer samples than a frame and
    the filters need, has no places. Whole recordings are read. phases: rows for each recording,
    which start at so many places within a hop; queries that are cut anywhere meet the frames of
    what they were cut from in one of these.
    """
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                codes, sounds, which = [], [], []
                for i, v in enumerate(batch.column(1).slice(lo, 256)):
                    if not v.is_valid:
                        raw = None
                    elif hasattr(v, "values"):
                        raw = v.values.to_numpy(zero_copy_only=False)
                    else:
                        raw = v.as_buffer()
                    samples = decode(raw) if raw is not None and len(raw) else np.zeros(0, np.float32)
                    for k in range(phases):
                        c, s = fingerprint(samples[k * HOP // phases :])
                        codes.append(c.astype("<u4").tobytes())
                        sounds.append(s.tobytes())
                        which.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256).take(pa.array(which, pa.int64())), pa.array([len(s) for s in sounds], pa.int64()), pa.array(codes, pa.binary()), pa.array(sounds, pa.binary())], names=["key", "n", "code", "sounding"])

    two = rows.select(F.col(id_col).alias("key"), F.col(audio_col).alias("audio"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(run, f"key {kind}, n bigint, code binary, sounding binary").withColumnRenamed("key", id_col)


#: Landmarks for each task, about, and the least number of tasks. A task of more is parted.
TASK_MARKS, LEAST_TASKS = 500_000, 64


#: Places ahead of a landmark's first integer where its others stand.
AHEAD = (2, 4)


def landmarks(code: np.ndarray, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, mark): a place's integer with those AHEAD, mixed to one of 64 bits, where all of them sound."""
    n = len(code) - max(AHEAD)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok, mark = sound[:n].copy(), code[:n].astype(np.uint64)
    for k in AHEAD:
        ok &= sound[k : k + n]
        mark = mix(mark + np.uint64(k)) ^ code[k : k + n]
    at = np.flatnonzero(ok)
    return at, mix(mark[at])


def _marks(tasks: int):
    """Landmarks of batches of recordings, by task: mark, which recording of the batch, place."""
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                got = [landmarks(np.frombuffer(c, "<u4"), np.frombuffer(s, bool)) for c, s in zip(part.column("code").to_pylist(), part.column("sounding").to_pylist(), strict=True)]
                which = np.repeat(np.arange(len(got)), [len(at) for at, _ in got]).astype(np.uint16)
                at, mark = (np.concatenate(x) if got else np.zeros(0, np.int64) for x in zip(*got, strict=True))
                task = (mark >> np.uint64(40)) % np.uint64(tasks)
                order = np.argsort(task, kind="stable")
                cut = np.searchsorted(task[order], np.arange(tasks + 1))
                nums = part.column("num").to_numpy().tobytes()
                rows = [(int(k), nums, mark[r].tobytes(), which[r].tobytes(), at[r].astype(np.uint32).tobytes(), len(r)) for k in np.flatnonzero(np.diff(cut)).tolist() for r in [order[cut[k] : cut[k + 1]]]]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:5]), pa.array(cols[5], pa.int64())], names=["task", "nums", "marks", "which", "places", "n"])

    return run


def _voter(batches):
    """(q, t, offset, votes): equal landmarks of a task's queries (which come first) and all recordings, counted by offset."""
    task, held = None, []
    for batch in batches:
        for k, side, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "nums", "marks", "which", "places")), strict=True):
            if k != task:
                task, held, index = k, [], None
            nums, mark, which, place = (np.frombuffer(v, d) for v, d in zip(row, (np.int64, np.uint64, np.uint16, np.uint32), strict=True))
            num, place = nums[which], place.astype(np.int64)
            if side == 0:
                held.append((mark, num, place))
                continue
            if not held:
                continue
            if index is None:
                qm, qn, qp = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(qm, kind="stable")
                index = qm[order], qn[order], qp[order]
            lo, hi = (np.searchsorted(index[0], mark, e) for e in ("left", "right"))
            hit = np.flatnonzero(hi > lo)
            ends = np.cumsum((hi - lo)[hit])
            # so many votes at once, however many recordings have a landmark
            for part in np.split(hit, np.searchsorted(ends, np.arange(2_000_000, int(ends[-1]) if len(ends) else 0, 2_000_000))):
                m = (hi - lo)[part]
                a, b = ranges(lo[part], m), np.repeat(part, m)
                if len(a):
                    q, t, off = index[1][a], num[b], place[b] - index[2][a]
                    by = np.lexsort((off, t, q))
                    q, t, off = q[by], t[by], off[by]
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(t) != 0) | (np.diff(off) != 0)]))
                    yield pa.RecordBatch.from_arrays([pa.array(q[new]), pa.array(t[new]), pa.array(off[new]), pa.array(np.diff(np.append(new, len(q))))], names=["q", "t", "offset", "votes"])


def bit_errors(q: list[tuple[np.ndarray, np.ndarray]], t: list[tuple[np.ndarray, np.ndarray]], offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of unequal bits where both sound, and at how many places they do, for each two (codes, sounding) at their offset."""
    join = lambda x, i: np.concatenate([y[i] for y in x]) if x else np.zeros(0, np.uint32)
    size = lambda x: np.array([len(c) for c, _ in x], np.int64)
    first = lambda n: np.cumsum(n) - n
    nq, nt = size(q), size(t)
    start = np.maximum(0, -offset)
    length = np.maximum(np.minimum(nq, nt - offset) - start, 0)
    x, y = ranges(first(nq) + start, length), ranges(first(nt) + start + offset, length)
    both = (join(q, 1)[x] & join(t, 1)[y]).astype(bool)
    who = np.repeat(np.arange(len(length)), length)
    over = np.bincount(who, both, len(length))
    return np.bincount(who, np.bitwise_count(join(q, 0)[x] ^ join(t, 0)[y]) * both, len(length)) / np.maximum(over, 1) / 32, over


def _judge(most_error: float, least_overlap: int):
    """Pairs (with both recordings' integers) whose bits agree."""
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                read = lambda c, s: [(np.frombuffer(x, "<u4"), np.frombuffer(y, bool)) for x, y in zip(part.column(c).to_pylist(), part.column(s).to_pylist(), strict=True)]  # noqa: E731,B023
                error, over = bit_errors(read("qc", "qs"), read("code", "sounding"), part.column("offset").to_numpy())
                ok = (over >= least_overlap) & (error <= most_error)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("q", "t", "offset", "votes")), pa.array(error)], names=["q", "t", "offset", "votes", "error"]).filter(pa.array(ok))

    return run


def align(asked: DataFrame, every: DataFrame, *, most_error: float = 0.2, least_votes: int = 1, least_overlap: int = 32) -> DataFrame:
    """q, t, offset, votes, error: for each recording asked for (num, code, sounding) those of every (the same columns) that are aligned with it.

    Landmarks are the index: they are shuffled by their integer, with the recording and the place,
    and those that a query and another recording share vote for an offset. The offset with the most
    votes (of equals that nearest to 0, then the lesser) is the pair's; with least_votes there, the
    bits over the overlap are compared. A landmark that very many recordings share has its task
    parted, and all its votes count. Both tables are read more than once.
    """
    total = every.agg(F.coalesce(F.sum(F.length("sounding")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(LEAST_TASKS, total // TASK_MARKS)
    shape = "task int, nums binary, marks binary, which binary, places binary, n bigint"
    of = lambda rows, side: rows.select("num", "code", "sounding").mapInArrow(_marks(tasks), shape).withColumn("side", F.lit(side))
    marks = written(of(asked, 0).unionByName(of(every, 1)), "landmarks")
    large = marks.filter("side = 1").groupBy("task").agg(F.ceil(F.sum("n") / (4 * TASK_MARKS)).cast("int").alias("parts")).filter("parts > 1")
    dealt = marks.join(F.broadcast(large), "task", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # fewer than landmarks / TASK_MARKS rows of 8 bytes
    own = F.array(F.pmod(F.xxhash64("nums"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    dealt = dealt.select(F.concat_ws(":", "task", "part").alias("task"), "side", "nums", "marks", "which", "places")
    votes = dealt.repartition("task").sortWithinPartitions("task", "side").mapInArrow(_voter, "q bigint, t bigint, offset bigint, votes bigint")
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.abs("offset").alias("a"), "offset")).alias("best")
    pairs = votes.groupBy("q", "t", "offset").agg(F.sum("votes").alias("votes")).filter(F.col("votes") >= least_votes).groupBy("q", "t").agg(best)
    pairs = written(pairs.select("q", "t", "best.offset", (-F.col("best.v")).alias("votes")), "aligned")
    both = join_on(pairs, every.select(F.col("num").alias("t"), "code", "sounding"), ["t"])
    both = join_on(written(both, "aligned"), asked.select(F.col("num").alias("q"), F.col("code").alias("qc"), F.col("sounding").alias("qs")), ["q"])
    return both.mapInArrow(_judge(most_error, least_overlap), "q bigint, t bigint, offset bigint, votes bigint, error double")


def search(prints: DataFrame, is_query, *, id_col: str, excerpts: DataFrame | None = None, **limits) -> DataFrame:
    """For each recording that is_query (a condition) holds for, the recordings aligned with it.

    prints are fingerprints(). Recordings with equal fingerprints are one class, whose least id
    stands for it; a class is matched once and its copies are counted. Returns <id_col>, class_id,
    n_copies (others of its class), n_matches (recordings of other classes aligned with it) and all
    of these classes, none is capped: matches array<struct<id,offset,votes,error>> by error, then id; offset is in frames, that of the
    match's place less that of the query's. Recordings without sound are in no class (null), have
    no copies and no matches. Repeated rows and null ids are recordings; a class of null ids alone has a null id.

    excerpts: fingerprints of altered recordings with known truth, by the id that each was made of
    (a row for each phase). They are sought too, and three more columns say how that went:
    excerpt_offset and excerpt_error of the best alignment with the own class (null if not found),
    excerpt_others (other classes aligned).
    limits: most_error, least_votes and least_overlap of align().
    """
    kind = prints.schema[id_col].dataType.simpleString()
    p = prints.select(F.col(id_col).alias("key"), is_query.alias("asks"), "code", "sounding")
    cls = F.when(F.instr(F.hex("sounding"), "01") > 0, F.unhex(F.substring(F.sha2(F.concat("code", "sounding"), 256), 1, 32)))
    p = written(p.withColumn("cls", cls), "prints")
    mine = written(p.filter("asks"), "queries")
    classes = p.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("asks").alias("asks"), F.first("code").alias("code"), F.first("sounding").alias("sounding"))
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    own = written(join_on(mine, classes.select("cls", "id", "copies", "num"), ["cls"], "left"), "queries")
    asked = classes.filter("asks").select("num", "code", "sounding")
    if excerpts is not None:  # numbered below nought
        e = excerpts.select(F.col(id_col).alias("e"), "code", "sounding").withColumn("num", -1 - F.monotonically_increasing_id())
        e = written(e.filter("e IS NOT NULL"), "excerpts")
        asked = asked.unionByName(e.select("num", "code", "sounding"))
    found = written(align(asked, classes.select("num", "code", "sounding"), **limits).filter("q <> t"), "found")
    named = join_on(found, classes.select(F.col("num").alias("t"), "id", "copies"), ["t"])
    near = f"array<struct<error:double,id:{kind},offset:bigint,votes:bigint>>"
    lists = named.filter("q >= 0").groupBy(F.col("q").alias("num")).agg(F.sum("copies").alias("n"), F.array_sort(F.collect_list(F.struct("error", "id", "offset", "votes"))).alias("best"))
    out = join_on(own, lists, ["num"], "left").select(
        F.col("key").alias(id_col),
        F.col("id").alias("class_id"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.transform(F.coalesce("best", F.array().cast(near)), lambda m: F.struct(m["id"].alias("id"), m["offset"].alias("offset"), m["votes"].alias("votes"), m["error"].alias("error"))).alias("matches"),
        *([] if excerpts is None else [F.col("num").alias("__num")]),
    )
    if excerpts is None:
        return out
    truth = e.join(out.select(F.col(id_col).alias("e"), F.col("__num").alias("want")).distinct(), "e").select("e", "num", "want")
    seen = truth.join(found.withColumnRenamed("q", "num"), "num", "left")
    best = F.min(F.when(F.col("t") == F.col("want"), F.struct("error", "offset"))).alias("x")
    told = seen.groupBy("e").agg(best, F.count_distinct(F.when(F.col("t") != F.col("want"), F.col("t"))).alias("excerpt_others"))
    told = told.select("e", F.col("x.offset").alias("excerpt_offset"), F.col("x.error").alias("excerpt_error"), "excerpt_others")
    return out.drop("__num").join(told, F.col(id_col) == F.col("e"), "left").drop("e")


#: A vector's recording: a chord for each number, of so many samples, of so many following numbers.
CHORD, VOICES = 512, 12
_TONES = np.array([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * np.arange(CHORD) / RATE) for k in range(VOICES)], np.float32)


def render(vector: np.ndarray) -> np.ndarray:
    """A recording of a vector: at each place a chord whose twelve voices are as loud as the numbers that follow (around the end)."""
    v = np.nan_to_num(np.asarray(vector, np.float32))
    if not len(v):
        return np.zeros(0, np.float32)
    loud = np.abs(np.take(v, np.arange(len(v))[:, None] + np.arange(VOICES), mode="wrap"))
    return (loud @ _TONES).ravel()


def excerpt(vector: np.ndarray, *, drop: float = 0.3, noise: float = 0.1) -> np.ndarray:
    """An altered recording of a vector: without its first part, which is no whole number of frames, louder by a half and with noise (a share of its own strength), drawn from the vector's bytes."""
    x = render(vector)
    x = x[int(len(x) * drop) :]
    if not len(x):
        return x
    r = np.random.default_rng(np.frombuffer(np.nan_to_num(np.asarray(vector, np.float32)).tobytes(), np.uint32))
    return 1.5 * x + r.normal(0, noise * float(np.sqrt(np.mean(x * x))) + 1e-9, len(x)).astype(np.float32)
