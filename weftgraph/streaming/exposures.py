"""Exposure buckets over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph.operators.measures import partials, time_buckets


def bucket_stream(exposures: DataFrame, resolution: str, aggregation: str = "avg", late: str = "1 hour") -> DataFrame:
    """time_buckets of a stream with a timestamp column ts: a bucket closes when `late` has passed beyond it."""
    return time_buckets(exposures.withWatermark("ts", late), resolution, aggregation)


def partial_stream(exposures: DataFrame, late: str = "1 hour") -> DataFrame:
    """partials of a stream: its hours can be appended to a table, which rolled_up reads for every resolution."""
    return partials(exposures.withWatermark("ts", late))
