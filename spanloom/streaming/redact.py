"""The same detection on streams: it is row-local, so no state and no watermark are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.detect import Detector
from ..operators.redact import LABEL, rewrite


def redact_stream(rows: DataFrame, detector: Detector | None = None, *, text: str = "text", label: str = LABEL) -> DataFrame:
    """Rows (streaming or not) with entities and redacted text."""
    found = rows.withColumn("entities", (detector or Detector()).detect(F.col(text)))
    return found.withColumn("redacted", rewrite(F.coalesce(F.col(text), F.lit("")), F.col("entities"), label))


def type_counts(rows: DataFrame, *, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entities by type and window of time (an addition: this one has state, bounded by the watermark)."""
    hits = rows.withWatermark(time, late).select(time, F.explode("entities").alias("e"))
    return hits.groupBy(F.window(time, window).alias("window"), F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def append_to(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends redacted rows as Parquet, each once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
