"""Fitted models over streams: scaling, imputing, flagging and clustering are projections, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, *models) -> DataFrame:
    """Each model's ``transform`` in turn, on a streaming DataFrame."""
    for model in models:
        stream = model.transform(stream)
    return stream


def windowed_summary(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours", by: str | None = None) -> DataFrame:
    """(window, n, mean, sd) with a watermark, so that state for closed windows is dropped."""
    keys = [F.window(time, width), *([F.col(by)] if by else [])]
    return stream.withWatermark(time, late).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
