"""Set operations (U1) and score-table joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate with the union of columns (missing → NULL), matched by name."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to concatenate")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def wide_scores(scores: DataFrame, algos: Sequence[str], key: str = "row_id",
                algo: str = "algo", score: str = "anomaly_score") -> DataFrame:
    """One column per algorithm keyed by ``row_id`` — one shuffle (pivot with a
    fixed value list) instead of a chain of k left joins."""
    return scores.groupBy(key).pivot(algo, list(algos)).agg(F.first(score))


def attach(rows: DataFrame, scores: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach scores to the source rows by explicit key (never by position)."""
    return rows.join(scores, key, "left")
