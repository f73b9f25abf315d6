"""Latest, nth and top-n rows per key.

Every limited pick is either a ``max_by`` style aggregate or a rank filter, which
Spark turns into a group limit ahead of the shuffle; neither moves a whole key
into one task.  Full numbering of large keys is ``sweeps.number_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key in the given order, numbered from 1."""
    window = Window.partitionBy(*by).orderBy(*_sort(order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def nth_row(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The n-th row per key (from 1)."""
    return first_rows(df, by, order, n, "_rank").filter(F.col("_rank") == n).drop("_rank")


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the row with the highest order per key."""
    pick = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v")))["v"].alias("_v")
    return df.groupBy(*by).agg(pick).select(*by, *[F.col(f"_v.{c}") for c in columns])


def earliest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    pick = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v")))["v"].alias("_v")
    return df.groupBy(*by).agg(pick).select(*by, *[F.col(f"_v.{c}") for c in columns])


def pivot_ranked(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], columns: Mapping[str, str], n: int,
) -> DataFrame:
    """The first n rows per key as numbered columns ``<name>_1`` to ``<name>_n``."""
    kept = first_rows(df, by, order, n, "_rank")
    return kept.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_rank") == i, F.col(column))).alias(f"{name}_{i}")
            for i in range(1, n + 1)
            for name, column in columns.items()
        ]
    )


def latest_previous_baseline(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str],
) -> DataFrame:
    """Latest, second latest and earliest row per key as prefixed columns."""
    down = [F.col(c).desc() for c in order]
    two = first_rows(df, by, down, 2, "_rank")
    newest = two.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_rank") == rank, F.col(column))).alias(f"{name}_{column}")
            for rank, name in ((1, "latest"), (2, "previous"))
            for column in columns
        ]
    )
    oldest = earliest_per_key(df, by, order, columns)
    oldest = oldest.select(*by, *[F.col(c).alias(f"baseline_{c}") for c in columns])
    return newest.join(oldest, list(by))


def newest_dates(df: DataFrame, by: Sequence[str], at: str, n: int) -> DataFrame:
    """All rows on the n newest distinct days per key.

    Days are reduced to one row each before they are ranked.
    """
    day = F.to_date(at)
    days = df.select(*by, day.alias("_day")).distinct()
    kept = first_rows(days, by, [F.col("_day").desc()], n, "_rank")
    return df.withColumn("_day", day).join(kept.drop("_rank"), [*by, "_day"], "left_semi").drop("_day")


def first_by_order_list(df: DataFrame, by: Sequence[str], column: str, preference: Sequence, tie: Sequence[str]) -> DataFrame:
    """One row per key: listed values in list order, unlisted values after them."""
    place = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(column))
    rank = F.when(place > 0, place).otherwise(F.lit(len(preference) + 1))
    return df.groupBy(*by).agg(F.min(F.struct(rank.alias("_r"), *tie, F.col(column).alias("_v")))["_v"].alias(column))
