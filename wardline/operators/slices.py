"""Spans joined with events by calendar slices.

A busy key is cut into slices of the calendar, so that it spreads over tasks;
``unit`` sets their width.  Spans are cut by month, because each is repeated once
per slice it touches.  Ordered operators deal rows by ranges instead (``sweeps``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLICE = "_slice"
# Slices that a span is cut into at most; all before them count as one.
SPAN_SLICES = 4096


def slice_number(at: Column, unit: str) -> Column:
    """Calendar slice as a growing integer; rows without a time sort first."""
    if unit == "year":
        number = F.year(at)
    elif unit == "month":
        number = F.year(at) * 12 + F.month(at)
    elif unit == "day":
        number = F.unix_date(F.to_date(at))
    elif unit == "hour":
        number = F.unix_date(F.to_date(at)) * 24 + F.hour(at)
    else:
        raise ValueError(f"unknown slice unit {unit!r}")
    return F.coalesce(number, F.lit(-(2**31))).cast("long")


def range_join(
    points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, stop: str,
    horizon: Column, unit: str = "month", how: str = "inner", grain: str = "timestamp",
) -> DataFrame:
    """Points inside [start, stop] of a span with the same key; null stop is open.

    Spans are cut into calendar slices and joined on (key, slice), so a busy key
    spreads over its slices and only spans that reach into the point's own slice
    are compared with it.  Open spans are cut up to ``horizon`` and everything
    later shares the horizon's slice, as everything over SPAN_SLICES before it shares
    the first, so the result depends on neither and a span from year 1 to year 9999 is
    cut no finer than that.  A span without a start matches nothing.
    ``grain='day'`` compares calendar days.
    """
    by = list(by)
    edge = slice_number(horizon, unit)

    def when(column: Column) -> Column:
        return F.to_date(column) if grain == "day" else column

    def inside(number: Column) -> Column:
        return F.greatest(F.least(number, edge), edge - SPAN_SLICES)

    last = F.when(F.col(stop).isNull(), edge).otherwise(inside(slice_number(F.col(stop), unit)))
    first = inside(slice_number(F.col(start), unit))
    cut = spans.filter(F.col(start).isNotNull()).withColumn(
        "_span_slice", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    )
    spread = points.withColumn(_SLICE, inside(slice_number(F.col(at), unit)))
    time, opened, closed = F.col(f"p.{at}"), F.col(f"s.{start}"), F.col(f"s.{stop}")
    condition = (
        reduce(lambda a, b: a & b, [F.col(f"p.{c}") == F.col(f"s.{c}") for c in by])
        & (F.col(f"p.{_SLICE}") == F.col("s._span_slice"))
        & (when(time) >= when(opened))
        & (closed.isNull() | (when(time) <= when(closed)))
    )
    joined = spread.alias("p").join(cut.alias("s"), condition, how)
    shared = set(by)
    return joined.select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"s.{c}") for c in spans.columns if c not in shared],
    )
