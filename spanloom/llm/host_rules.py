"""Quality rules by document and by host.

Each document's numbers are counted in numpy; rules over them give failures. Failures are summed by
host, each rule's rates over all hosts give a beta prior (by moments), and a host's rate is shrunk
towards it: a host of few documents keeps close to the mean of all. A host is refused, with all its
documents, if its shrunken rate for a rule lies over the mean of all hosts by more than a margin and
twice the rate's own deviation: by what it is known to differ, and not by how much fails everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import join_on, written
from .textbuf import Packed, points, slices, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _again(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are equal to another one of their row, and which to an earlier one (entries are in order)."""
    order = np.lexsort((np.arange(len(row)), number, row))
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = (number[order[1:]] == number[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    found, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    found[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return found, later


def count_slice(buf: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """COUNTS for each text of a slice."""
    n = len(offs) - 1
    start, end, first = words(buf, offs)
    chars = points(buf)
    sums = np.zeros(len(start) + 1, np.int64)
    np.cumsum(chars[end] - chars[start], out=sums[1:])
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])
    # windows of words
    row = np.repeat(np.arange(n), np.diff(first))
    word = Packed.of(buf, start, end)
    at, number = windows(word.numbers(), row, window, word.hash)
    found, _ = _again(row[at], number)
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + window, -1)
    repeated = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.cumsum(cover[:-1]) > 0, out=repeated[1:])
    # lines with a word; a break at a text's end starts an empty line, which has none
    breaks = np.flatnonzero(buf == 10)
    brow = np.searchsorted(offs, breaks, side="right") - 1
    more = breaks + 1 < offs[brow + 1]
    ls = np.concatenate([offs[:-1], breaks[more] + 1])
    lrow = np.concatenate([np.arange(n), brow[more]])
    le = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, ls)], offs[lrow + 1])
    solid = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, lrow = ls[solid], le[solid], lrow[solid]
    order = np.argsort(ls, kind="stable")
    ls, le, lrow = ls[order], le[order], lrow[order]
    _, later = _again(lrow, Packed.of(buf, ls, le).numbers())
    return {
        "n_words": np.diff(first),
        "word_chars": sums[first[1:]] - sums[first[:-1]],
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": np.bincount(lrow[later], minlength=n)[:n],
        "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
        "n_lines": np.bincount(lrow, minlength=n)[:n],
    }


def _counter(window: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                got = count_slice(buf, offs, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["key", "host", *COUNTS])

    return run


def rules(*, least_words: int = 10, most_repeated: int = 20, most_symbols: int = 10, most_dup_lines: int = 30) -> dict[str, Column]:
    """A document's failures; limits are in words and in percent of its words, word characters and lines with a word."""
    return {
        "base": (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > most_symbols * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > most_dup_lines * F.col("n_lines"),
    }


def prior(n: int, rate: float, square: float, inverse: float) -> tuple[float, float]:
    """alpha and beta by moments from the hosts' number, mean rate, mean squared rate and mean of 1 / documents.

    The variance of rates is that of the hosts plus what the draw of documents adds; where the first
    isn't over nought, hosts don't differ and the prior is as strong as 1e6 documents. A mean of 0 or
    1 is held off the edge.
    """
    m = min(max(rate, 1e-4), 1 - 1e-4)
    between = square - rate * rate - m * (1 - m) * inverse
    if n < 2 or between <= 0:
        strength = 1e6 if n >= 2 else 1.0
    else:
        strength = min(max(m * (1 - m) / between - 1, 0.1), 1e6)
    return m * strength, (1 - m) * strength


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 5, margin: float = 0.2, deviations: float = 2.0) -> DataFrame:
    """<id_col>, the COUNTS (long), base_failed and kept (boolean) of every row.

    kept is false for rows that fail the base rule and for rows of a refused host: one whose
    shrunken rate for any rule, less so many deviations of it, is over the hosts' mean rate by more
    than the margin (at the very margin it stays). Each host counts once in that mean. A null or
    empty text has no words and fails the base rule. Rows with a null host are judged by themselves
    alone, and are no host. Repeated rows count each time. An empty table gives no rows. Only the
    three named columns are read.
    """
    three = docs.select(F.col(id_col).alias("key"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    kind = three.schema["key"].dataType.simpleString()
    counted = three.mapInArrow(_counter(window), f"key {kind}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    counted = written(counted, "counts")
    failing = rules()
    hosts = written(counted.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(r) for r, c in failing.items()]), "hosts")
    moments = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.avg(1 / F.col("n")).alias("inverse"), *[x for r in failing for x in (F.avg(F.col(r) / F.col("n")).alias(f"{r}_1"), F.avg((F.col(r) / F.col("n")) ** 2).alias(f"{r}_2"))]).first()
    refused = F.lit(False)
    for r in failing:
        a, b = prior(moments["hosts"], moments[f"{r}_1"] or 0.0, moments[f"{r}_2"] or 0.0, moments["inverse"] or 0.0)
        rate = (F.col(r) + a) / (F.col("n") + (a + b))
        refused = refused | (rate - deviations * F.sqrt(rate * (1 - rate) / (F.col("n") + (a + b + 1))) > (moments[f"{r}_1"] or 0.0) + margin)
    bad = hosts.filter(refused).select("host", F.lit(True).alias("refused"))
    out = join_on(counted, bad, ["host"], "left").withColumn("base_failed", failing["base"])
    return out.select(F.col("key").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & F.col("refused").isNull()).alias("kept"))
