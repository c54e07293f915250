"""Rendering of streams: a template is a projection, so a stream is rendered like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..template import Template


def render_stream(df: DataFrame, template: Template, out: str = "out", **how) -> DataFrame:
    return template.render(df, out, **how)


def windowed_lists(df: DataFrame, time: str, window: str, late: str, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """One row for each window and key, with the window's rows as a list of structs in order of time, then field values."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(time, *fields))).alias("_rows"))
    return listed.withColumn(name, F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))).drop("_rows")
