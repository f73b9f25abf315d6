"""Grouped counts, totals, lists and fixed row layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.sweeps import PART, RANGES, deal, split_points


def conditional_counts(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """How many rows of each key meet each condition."""
    return df.groupBy(*by).agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def presence_flags(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """True where any row of the key meets the condition, else null."""
    return df.groupBy(*by).agg(*[F.bool_or(F.when(cond, True)).alias(name) for name, cond in conditions.items()])


def group_by_case(df: DataFrame, cases: Sequence[tuple[Column, Column]], otherwise: Column, label: str, aggs: Sequence[Column]) -> DataFrame:
    """Group by the label of the first matching case."""
    out = otherwise
    for condition, value in reversed(list(cases)):
        out = F.when(condition, value).otherwise(out)
    return df.groupBy(out.alias(label)).agg(*aggs)


def string_agg(df: DataFrame, by: Sequence[str], column: str, order: str, out: str, separator: str = ",") -> DataFrame:
    """All values of a key as one text, in the given order; null when there are none.

    The result itself is one text per key, put together range by range; for answers use
    the distinct lists of ``collect_obs``, which are bounded by the dictionary.
    """
    return ordered_text(df, by, column, [order, column], out, separator)


def ordered_text(
    df: DataFrame, by: Sequence[str], column: str, order: Sequence[str], out: str, separator: str, ranges: int = RANGES,
) -> DataFrame:
    """Values of a key joined in the given order, null values left out; one row per key of ``df``.

    Rows are dealt by ranges of (key, order); each range is sorted and joined on its own,
    and a key's texts are then joined in the order of their ranges, so that no task
    sorts more of a key than one range of it.
    """
    rows = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(column).cast("string").alias("_v"))
    places = [f"_o{i}" for i in range(len(order))]
    dealt = deal(rows, split_points(rows, by, places, ranges))
    pair = F.when(F.col("_v").isNotNull(), F.struct(*places, "_v"))
    items = F.array_sort(F.collect_list(pair))
    texts = dealt.groupBy(*by, PART).agg(F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: i["_v"]), separator)).alias("_t"))
    parts = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(PART, "_t"))))
    whole = F.array_join(F.transform(parts, lambda i: i["_t"]), separator)
    return texts.groupBy(*by).agg(F.when(F.size(parts) > 0, whole).alias(out))


def total_row(df: DataFrame, label: str, measures: Sequence[str], total: str = "Total") -> DataFrame:
    """Sums per label and a grand total row from the same pass."""
    return (
        df.rollup(label).agg(*[F.sum(m).alias(m) for m in measures], F.grouping(label).alias("_total"))
        .withColumn(label, F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(label)))
        .drop("_total")
    )


def scaffold_zero_fill(
    rows: DataFrame, counts: DataFrame, label: str, measures: Sequence[str], drop_when_zero: Sequence[str] = (),
) -> DataFrame:
    """A fixed list of output rows with counts defaulting to 0.

    Labels in ``drop_when_zero`` disappear when all their measures are 0.
    """
    out = rows.join(counts.select(label, *measures), label, "left").select(
        label, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]
    )
    if drop_when_zero:
        empty = F.col(label).isin(list(drop_when_zero))
        for m in measures:
            empty = empty & (F.col(m) == 0)
        out = out.filter(~empty)
    return out


def append_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both row sets; columns only one of them has are null in the other."""
    return first.unionByName(second, allowMissingColumns=True)
