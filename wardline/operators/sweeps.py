"""Ordered operators over keys of any size, dealt by ranges of (key, time, tie-break).

A window over one patient puts all of that patient's rows into one task.  Here rows
are cut into ranges of their order instead: split points from a fixed-size sample say
which range a row lies in, so one key, one day and one instant spread over as many
tasks as their rows ask for.  The window runs per (range, key).  What must cross a
border travels as one row for each key that lies on one, at most two per range,
which is why those rows may be broadcast.  The rows themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges that rows are dealt to, and sampled rows for each split point.
RANGES = 64
SAMPLED = 16
PART = "_part"
_PLACE = "_place"


@dataclass(frozen=True)
class Splits:
    """Sorted split points of rows in the order of (key, order), as constants of SQL."""

    by: Sequence[str]
    order: Sequence[str]
    places: Sequence[str]
    keys: Sequence[str]

    def part(self) -> Column:
        """How many splits are at or before the row, found by halving."""

        def passed(low: int, high: int) -> str:
            if low == high:
                return str(low)
            middle = (low + high) // 2
            return f"CASE WHEN {_PLACE} >= {self.places[middle]} THEN {passed(middle + 1, high)} ELSE {passed(low, middle)} END"

        return F.expr(passed(0, len(self.places)))

    def on_border(self) -> Column:
        """Whether the row's key may lie on a border between ranges: it is then a split's key."""
        if not self.keys:
            return F.lit(False)
        return F.expr(f"struct({', '.join(f'`{c}`' for c in self.by)}) IN ({', '.join(self.keys)})")


def _constant(text: str | None, kind: str) -> str:
    if text is None:
        return f"CAST(NULL AS {kind})"
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{quoted}' AS {kind})"


def split_points(rows: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int) -> Splits:
    """Splits for about equal ranges, from the ``SAMPLED`` rows a range that have the lowest hashes.

    Like a sort by range, this reads the sort columns once beforehand; at most
    ``ranges * SAMPLED`` rows come to the driver, whatever the table's size.
    """
    names = [*by, *order]
    kinds = [rows.schema[n].dataType.simpleString() for n in names]
    slim = rows.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])
    columns = slim.columns
    sample = slim.orderBy(F.xxhash64(*columns), *columns).limit(ranges * SAMPLED).orderBy(*columns)
    found = sample.select(*[F.col(c).cast("string") for c in columns]).collect()
    picked = list(dict.fromkeys(tuple(found[i]) for i in range(SAMPLED, len(found), SAMPLED)))

    def constant(row: tuple, size: int) -> str:
        return f"struct({', '.join(_constant(text, kind) for text, kind in zip(row[:size], kinds[:size], strict=True))})"

    # Rows without a key carry nothing.
    keys = dict.fromkeys(constant(row, len(by)) for row in picked if None not in row[: len(by)])
    return Splits(tuple(by), tuple(order), tuple(constant(row, len(names)) for row in picked), tuple(keys))


def deal(rows: DataFrame, splits: Splits) -> DataFrame:
    """The rows with the number of their range."""
    return rows.withColumn(_PLACE, F.struct(*splits.by, *splits.order)).withColumn(PART, splits.part()).drop(_PLACE)


def _carried(dealt: DataFrame, splits: Splits, aggregates: Sequence[Column], carry: Sequence[Column]) -> DataFrame:
    """One row per range and key on a border: what earlier ranges hand over.

    A range has two borders, so there are at most twice as many rows as ranges.
    """
    ends = dealt.filter(splits.on_border()).groupBy(*splits.by, PART).agg(*aggregates)
    return F.broadcast(ends.select(*splits.by, PART, *carry))


def _with_carry(rows: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, PART]
    test = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys]
    return rows.alias("l").join(carry.alias("r"), reduce(lambda a, b: a & b, test), "left")


def _earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, by: Sequence[str], at: str, order: Sequence[str],
    asc: str = "index_asc", desc: str | None = "index_desc", ranges: int = RANGES,
) -> DataFrame:
    """Position of each row within its key from the first and from the last.

    ``at`` is the leading sort column and ``order`` the tie-break; together they
    must be a total order.  Both positions come from one shuffle and the counts of
    keys on borders.  Rows without a key get no number; rows without a time come first.
    """
    by = list(by)
    splits = split_points(df, by, [at, *order], ranges)
    dealt = deal(df, splits)
    whole = Window.partitionBy(*by)
    carry = _carried(
        dealt, splits, [F.count(F.lit(1)).alias("_n")],
        [F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all")],
    )
    local = Window.partitionBy(PART, *by)
    rows = dealt.withColumn("_at", F.row_number().over(local.orderBy(at, *order)))
    if desc:
        rows = rows.withColumn("_here", F.count(F.lit(1)).over(local))
    known = reduce(lambda a, b: a & b, [F.col(f"l.{c}").isNotNull() for c in by])
    place = F.col("_at") + F.coalesce("_before", F.lit(0))
    out = [F.when(known, place).cast("long").alias(asc)]
    if desc:
        out.append(F.when(known, F.coalesce("_all", "_here") - place + 1).cast("long").alias(desc))
    return _with_carry(rows, carry, by).select(*[F.col(f"l.{c}") for c in df.columns], *out)


def previous_values(
    df: DataFrame, by: Sequence[str], at: str, order: Sequence[str], columns: Sequence[str],
    prefix: str = "previous_", ranges: int = RANGES,
) -> DataFrame:
    """Columns of the row before in the key's order, across range borders; null on the first row and without a key."""
    by = list(by)
    packed = F.struct(*columns)
    splits = split_points(df, by, [at, *order], ranges)
    dealt = deal(df, splits)
    last = F.max(F.struct(F.struct(at, *order).alias("o"), packed.alias("v")))["v"].alias("_last")
    carry = _carried(dealt, splits, [last], [F.lag("_last").over(Window.partitionBy(*by).orderBy(PART)).alias("_carry")])
    rows = dealt.withColumn("_prev", F.lag(packed).over(Window.partitionBy(PART, *by).orderBy(at, *order)))
    known = reduce(lambda a, b: a & b, [F.col(f"l.{c}").isNotNull() for c in by])
    previous = F.when(known, F.coalesce(F.col("_prev"), F.col("_carry")))
    return _with_carry(rows, carry, by).select(
        *[F.col(f"l.{c}") for c in df.columns], *[previous[c].alias(f"{prefix}{c}") for c in columns]
    )


@dataclass(frozen=True)
class Points:
    """What events look back at: the best row of ``rows`` that starts by then.

    The best is the highest ``best`` (by default the latest start, then the highest
    ``order``); ``take`` are the columns it gives, ``strict`` wants it before the event.
    """

    rows: DataFrame
    start: str
    take: Sequence[str]
    order: Sequence[str] = ()
    best: Sequence[str] | None = None
    strict: bool = False


def look_back(
    events: DataFrame, sources: Sequence[Points], by: Sequence[str], at: str, grain: str = "timestamp", ranges: int = RANGES,
    sample: DataFrame | None = None,
) -> DataFrame:
    """For each event the best point of every source, in one sweep over all of them.

    Events and points are dealt together by (key, time, side, hash): a point lies before
    an event of the same instant, or after it when strict, and the hash spreads
    rows of one instant.  Each range keeps the best point seen so far; the best of earlier
    ranges comes with the border rows.  ``grain='day'`` compares calendar days.  Every
    event is kept; the columns taken are null where no point qualifies.  ``sample`` may
    name a table of (key, ``_at``) that is cheaper to read and spread alike: split
    points decide how evenly rows are dealt, never the result.
    """
    by = list(by)

    def when(column: str) -> Column:
        return F.to_date(column).cast("timestamp_ntz") if grain == "day" else F.col(column)

    plain = [f.name for f in events.schema if not isinstance(f.dataType, T.MapType)]
    both = events.select(
        *by, when(at).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*plain).alias("_tie"), F.struct(*events.columns).alias("_event")
    )
    for i, source in enumerate(sources):
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, source.start)])
        rank = F.struct(*(source.best or [source.start, *source.order]))
        pick = F.struct(rank.alias("o"), F.struct(*source.take).alias("v"))
        side = source.rows.filter(known).select(
            *by, when(source.start).alias("_at"), F.lit(2 if source.strict else 0).alias("_side"), F.xxhash64(pick).alias("_tie"), pick.alias(f"_pick{i}")
        )
        both = both.unionByName(side, allowMissingColumns=True)
    order = ["_at", "_side", "_tie"]
    seen_by = both if sample is None else sample.withColumns({"_side": F.lit(0), "_tie": F.lit(0).cast("long")})
    splits = split_points(seen_by, by, order, ranges)
    dealt = deal(both, splits)
    picks = [f"_pick{i}" for i in range(len(sources))]
    carry = _carried(dealt, splits, [F.max(p).alias(p) for p in picks], [F.max(p).over(_earlier(by)).alias(f"_carry{p}") for p in picks])
    seen = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumns({f"_here{p}": F.max(p).over(seen) for p in picks}).filter(F.col("_event").isNotNull())
    # greatest skips nulls and compares the ranks first.
    chosen = [F.greatest(f"_here{p}", f"_carry{p}")["v"][c].alias(c) for p, source in zip(picks, sources, strict=True) for c in source.take]
    return _with_carry(found, carry, by).select("_event.*", *chosen)


def asof_backward(
    events: DataFrame, points: DataFrame, by: Sequence[str], at: str, start: str,
    take: Sequence[str], order: Sequence[str] = (), grain: str = "timestamp",
    strict: bool = False, best: Sequence[str] | None = None, ranges: int = RANGES, sample: DataFrame | None = None,
) -> DataFrame:
    """For each event the best point of the same key that starts at or before it; see ``look_back``."""
    return look_back(events, [Points(points, start, take, order, best, strict)], by, at, grain, ranges, sample)
