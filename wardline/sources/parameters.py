"""Typed report parameters, bound as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from wardline.functions.dates import day_start
from wardline.operators.filters import Shift, shift_window


@dataclass(frozen=True)
class ReportParameters:
    """What a report request may carry; unset values do not restrict."""

    start_date: date | None = None
    end_date: date | None = None
    day: date | None = None
    location: object = None
    shift: str | None = None
    extra: Mapping[str, object] = field(default_factory=dict)

    def window(self, end_inclusive: bool = False) -> Shift:
        if self.day is None or self.shift is None:
            raise ValueError("day and shift are required")
        return shift_window(self.day, self.shift, end_inclusive)


# Parameter names of a request and the kind each carries.
KINDS = {
    "startDate": ("start_date", "date"),
    "endDate": ("end_date", "date"),
    "date": ("day", "date"),
    "handoverDate": ("day", "date"),
    "locationUUID": ("location", "text"),
    "shift": ("shift", "text"),
}


def bind_parameters(given: Mapping[str, object], presets: Mapping[str, object] | None = None) -> ReportParameters:
    """Typed parameters from a request; presets of a data set override it."""
    values: dict[str, object] = {}
    extra: dict[str, object] = {}
    for name, value in {**given, **(presets or {})}.items():
        if name not in KINDS:
            extra[name] = value
            continue
        target, kind = KINDS[name]
        if value is not None and kind == "date":
            value = day_start(value).date()
        values[target] = value
    return ReportParameters(**values, extra=extra)
