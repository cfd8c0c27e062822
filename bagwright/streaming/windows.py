"""Keyed tables over time: the same calls for a batch and for a stream.

Operators that keep keys whole (map, joins with a fixed right side, split, bind, extend_key) run on a
streaming DataFrame as they are. Here are those that need time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """``aggregates`` per tumbling (or, with ``slide``, sliding) window and key; window_start joins the key.

    On a stream ``late`` is the watermark: in append mode a window comes out once it is closed.
    """
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(window.alias("_window"), *keys).agg(*aggregates).select(F.col("_window.start").alias("window_start"), *keys, *(c for c in _names(df, aggregates)))


def _names(df: DataFrame, aggregates: list[Column]) -> list[str]:
    return df.limit(0).agg(*aggregates).columns if not df.isStreaming else df.sparkSession.createDataFrame([], df.schema).agg(*aggregates).columns


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of each key with the largest ``ts`` (of equal ones, the largest ``tie``); streams in update mode."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def valid_at(at: str, since: str, until: str) -> Column:
    """Whether what holds from ``since`` up to, not including, ``until`` (missing: without end) holds at ``at``."""
    return (F.col(since) <= F.col(at)) & (F.col(until).isNull() | (F.col(at) < F.col(until)))


def join_valid(left: DataFrame, right: DataFrame, on: list[str], at: str, since: str, until: str, how: str = "inner") -> DataFrame:
    """Each row of ``left`` (a batch or a stream) with the rows of the fixed ``right`` of equal ``on`` that hold at its time; ``how`` may be left.

    Equal keys decide where rows meet, the interval is tested there. Missing keys or times meet nothing.
    """
    if clash := sorted((set(left.columns) & set(right.columns)) - set(on)):
        raise ValueError(f"both sides have columns {clash}")
    if how not in ("inner", "left"):
        raise ValueError("an interval join is inner or left")
    other = right.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
    test = valid_at(at, since, until)
    for i, c in enumerate(on):
        test &= F.col(c) == F.col(f"_on_{i}")
    return left.join(other, test, how).drop(*(f"_on_{i}" for i in range(len(on))))


def refreshed(stream: DataFrame, view: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that gives each change of ``view(stream)`` to ``save(changes, batch)``."""
    return view(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
