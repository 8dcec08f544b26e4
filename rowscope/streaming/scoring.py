"""Scoring a stream with a frozen model (the §2.14 extension).

A model fitted in batch (here INNE centres and radii) is collected once and
broadcast; the ``mapInPandas`` scorer is map-only, so it runs unchanged on a
streaming DataFrame and scores each micro-batch as it arrives. Windowed counts
of flagged rows use an event-time watermark, so state of closed windows is
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect import inne


def score_stream(stream: DataFrame, model: DataFrame, id_col: str, time_col: str,
                 features: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """``(row_id, time, score)`` for every arriving row, from a batch-fitted INNE model."""
    if array_col:
        x = F.transform(F.col(array_col), lambda v: v.cast("double"))
    else:
        x = F.array(*[F.col(c).cast("double") for c in features or []])
    fm = stream.select(F.col(id_col).cast("long").alias("row_id"), F.col(time_col).alias("time"), x.alias("x"))
    return inne.score(fm, model, keep=("time",))


def windowed_alerts(scored: DataFrame, threshold: float, window: str = "10 minutes",
                    watermark: str = "30 minutes") -> DataFrame:
    """Per event-time window: rows, rows scored at or above ``threshold``, max score."""
    return (scored.withWatermark("time", watermark)
            .groupBy(F.window("time", window))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("score") >= threshold).alias("alerts"),
                 F.max("score").alias("max_score")))
