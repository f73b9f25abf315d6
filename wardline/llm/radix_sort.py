"""A distributed radix sort: stable counting passes from the lowest digit to the highest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import written

DIGIT_BITS = 12
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 10, 1 << 20, 256


def _digit(low_bits: int, shift: int, bits: int) -> Column:
    """Bits ``shift`` to ``shift + bits`` of the number that holds ``high`` above ``low_bits`` bits of ``low``."""
    mask = F.lit((1 << bits) - 1)
    if shift >= low_bits:
        return F.shiftrightunsigned("high", shift - low_bits).bitwiseAND(mask)
    taken = min(bits, low_bits - shift)
    digit = F.shiftrightunsigned("low", shift).bitwiseAND(F.lit((1 << taken) - 1))
    if taken < bits:
        digit = digit.bitwiseOR(F.shiftleft("high", taken).bitwiseAND(mask))
    return digit


def radix_ranks(rows: DataFrame, high: Column, low: Column, row: str, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """(row, place): the place, from 0, of each row in the order of (``high``, ``low``), equal keys in the order of ``row``.

    ``high`` and ``low`` are longs that are not null, ``high`` not negative; ``low`` is
    ordered as a signed number.  ``row`` numbers the rows of a stored table and holds
    the table's partition above bit 33, as ``monotonically_increasing_id`` gives it.

    Bits that are the same in all keys are left out.  For each digit, rows are counted
    by block and digit; offsets are the counts of lower digits and, within a digit, of
    earlier blocks; a row's destination is its offset plus its place among the rows
    of its block and digit.  Destinations say which block a row lies in for the next
    pass and, after the last, its rank.  Each pass is written.  A block holds at most
    ``MOST_BLOCK`` rows, so no task's share depends on how keys are spread.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    keys = written(rows.select(F.col(row).alias("row"), high.alias("high"), low.bitwiseXOR(sign).alias("low")), "keys")
    spans = [f(c).alias(f"{c}{i}") for c in ("high", "low") for i, f in enumerate((F.bit_or, F.bit_and))]
    found = keys.agg(F.count(F.lit(1)).alias("n"), *spans).first()
    if not found["n"]:
        return keys.select("row", F.lit(0).cast("long").alias("place"))

    def varying(column: str) -> int:
        return ((found[f"{column}0"] ^ found[f"{column}1"]) & (1 << 64) - 1).bit_length()

    low_bits, all_bits = varying("low"), varying("low") + varying("high")
    size = min(max(found["n"] // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    now = keys.select("row", "high", "low", F.col("row").alias("slot"), F.shiftrightunsigned("row", 33).alias("block"))
    for shift in range(0, max(all_bits, 1), digit_bits):
        dealt = now.withColumn("digit", _digit(low_bits, shift, min(digit_bits, max(all_bits - shift, 1))))
        counts = dealt.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
        # At most 2 ** digit_bits rows, whatever the table's size.
        totals = counts.groupBy("digit").agg(F.sum("n").alias("all"))
        below = F.coalesce(F.sum("all").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.withColumn("before", before).join(totals.select("digit", below.alias("below")), "digit")
        offsets = offsets.select("block", "digit", (F.col("below") + F.col("before")).alias("offset"))
        local = F.row_number().over(Window.partitionBy("block", "digit").orderBy("slot")) - 1
        placed = dealt.withColumn("local", local).join(offsets, ["block", "digit"])
        slot = (F.col("offset") + F.col("local")).alias("slot")
        moved = placed.select("row", "high", "low", slot, F.floor((F.col("offset") + F.col("local")) / size).alias("block"))
        now = written(moved, "pass")
    return now.select("row", F.col("slot").alias("place"))
