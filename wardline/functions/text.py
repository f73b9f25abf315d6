"""Text columns: site prefixes, identifiers, packed addresses, output cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the canonical text form of a UUID.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Fixed value: characters outside basic Latin and letters are dropped on export.
UNPRINTABLE = r"[^\p{InBasicLatin}\p{L}]"


def site_key(column: Column, site: str | None) -> Column:
    """``site-id`` when the site is a number, else the id as text."""
    key = column.cast("string")
    if site is not None and site.isascii() and site.isdigit():
        return F.concat(F.lit(f"{site}-"), key)
    return key


def is_uuid(column: Column) -> Column:
    return column.rlike(UUID_PATTERN)


def ilike_any(column: Column, patterns: Sequence[str]) -> Column:
    """True when any case-insensitive pattern matches."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | column.ilike(pattern)
    return found


def relabel(column: Column, names: Mapping[str, str]) -> Column:
    """Whole-value replacement of labels; others pass unchanged."""
    out = column
    for old, new in names.items():
        out = F.when(column == F.lit(old), F.lit(new)).otherwise(out)
    return out


def reword(column: Column, words: Mapping[str, str]) -> Column:
    """Replacement inside a text, in the given order."""
    out = column
    for old, new in words.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def format_address(*parts: Column) -> Column:
    """Address parts in display order, missing and blank parts skipped."""
    kept = [F.when(F.trim(part) != "", part) for part in parts]
    return F.concat_ws(", ", *kept)


def packed_parts(column: Column, names: Sequence[str], separator: str = "|") -> dict[str, Column]:
    """Columns for a value packed into one field.

    A value without the separator is left in the first column; a single letter
    there is junk and every other part becomes blank either way.
    """
    pieces = F.split(column, "\\" + separator)
    return {
        name: F.coalesce(F.get(pieces, F.lit(position)), F.lit(""))
        for position, name in enumerate(names)
    }


def printable(column: Column) -> Column:
    return F.regexp_replace(column, UNPRINTABLE, "")
