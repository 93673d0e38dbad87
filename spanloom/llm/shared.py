"""Joins on keys that many rows have; tables between the steps of a job are those of the whole package."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..tables import scope, shared_dir, written

__all__ = ["HOT_ROWS", "HOT_SHARE", "join_on", "scope", "shared_dir", "written"]

#: A key of more than this share of all rows, and of so many rows at least, is a hot one; so there are fewer hot keys than 1 / share.
HOT_SHARE, HOT_ROWS = 0.001, 500


def join_on(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keyed (a row for each key), inner, left or left_semi, where a few keys may have a third of all rows.

    Keys are counted first (sums before the shuffle). The hot ones, fewer than 1 / HOT_SHARE of them
    whatever the size, are joined by broadcast, so their rows stay where they are; the rest is
    shuffled, and no key of it has more than that share of the rows. Rows with a null key match
    nothing and are not shuffled at all. rows is read more than once: a table.
    """
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    apart, rows = rows.filter(~whole), rows.filter(whole)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = counts.filter((F.col("n") > HOT_ROWS) & (F.col("n") > total * HOT_SHARE)).drop("n")
    found = hot.collect()
    if not found:
        out = rows.join(keyed, keys, how)
        return out.unionByName(apart, allowMissingColumns=True) if how == "left" else out
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    rest = rows.join(hot, keys, "left_anti").join(keyed, keys, how)
    few = F.broadcast(keyed.join(hot, keys, "left_semi"))
    out = rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(rest)
    return out.unionByName(apart, allowMissingColumns=True) if how == "left" else out
