"""The row-local operators on streams, and running metrics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def decide_stream(rows: DataFrame, z: str, temperature: float = 1.0) -> DataFrame:
    """rows (batch or stream) with p; nothing is kept between rows."""
    return rows.withColumn("p", S.sigmoid(F.col(z) / temperature))


def windowed_rates(events: DataFrame, ts: str, p: str, y: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, mean prediction and mean outcome by window of event time; late rows are taken up to the watermark."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y")).select(F.col("w.start").alias("start"), "n", "mean_p", "mean_y")
