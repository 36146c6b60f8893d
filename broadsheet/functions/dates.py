"""Date parsing on columns and calendar stepping for bins and frames."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import strip

# A date is year, month and day with one separator (-, /, . or none) throughout, with
# or without anything after a "T", or a full ISO date with a time of day after a blank.
DATE_SPELLING = r"^(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(T.*)?$"
ISO_WITH_TIME = r"^(\d{4})-(\d{2})-(\d{2}) ([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
UNITS = ("day", "week", "month", "year")


def day_text(raw: Column) -> Column:
    """Trimmed text before a ``T``."""
    return F.split(strip(raw.cast("string")), "T", 2)[0]


def parse_date(raw: Column) -> Column:
    """Date from any accepted spelling; anything else is null."""
    text = strip(raw.cast("string"))
    iso = F.regexp_replace(F.regexp_replace(text, DATE_SPELLING, "$1-$3-$4"), ISO_WITH_TIME, "$1-$2-$3")
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), iso.try_cast("date"))


def format_date(raw: Column) -> Column:
    """``YYYY-MM-DD`` where the text is a date, else the text itself without its time part."""
    text = F.coalesce(raw.cast("string"), F.lit(""))
    return F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), day_text(text))


def as_day(value: str | dt.date) -> dt.date:
    """Strict ``YYYY-MM-DD`` argument."""
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"dates must look like YYYY-MM-DD, not {value!r}") from None


def day_range(start: str | dt.date, end: str | dt.date) -> tuple[str, str]:
    """Validated inclusive range as ISO text."""
    lo, hi = as_day(start), as_day(end)
    if hi < lo:
        raise ValueError("the end date lies before the start date")
    return lo.isoformat(), hi.isoformat()


def unit_name(unit: str, strict: bool = True) -> str:
    """``day``/``week``/``month``/``year`` from any spelling that starts so."""
    text = (unit or "").strip().lower()
    for known in UNITS:
        if text.startswith(known):
            return known
    if strict:
        raise ValueError(f"unknown calendar unit: {unit!r}")
    return "month"


def step(day: dt.date, unit: str, size: int) -> dt.date:
    """One step on; month and year steps keep the day or fall back to the month's last day."""
    if unit in ("day", "week"):
        return day + dt.timedelta(days=size * (7 if unit == "week" else 1))
    months = day.year * 12 + day.month - 1 + size * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def step_column(day: Column, unit: str, size: int) -> Column:
    if unit in ("day", "week"):
        return F.date_add(day, size * (7 if unit == "week" else 1))
    return F.add_months(day, size * (12 if unit == "year" else 1))


def bin_edges(start: dt.date, end: dt.date, unit: str, size: int) -> list[dt.date]:
    """Left edges from ``start``, each stepped from the one before, and a closing edge past ``end``."""
    unit = unit_name(unit)
    if size < 1:
        raise ValueError("a bin spans at least one unit")
    edges = [start]
    while edges[-1] <= end:
        edges.append(step(edges[-1], unit, size))
    return edges


def parse_bin(text: str) -> tuple[int, str]:
    """``"2 weeks"`` as (2, "week"); text of any other form means one month."""
    form = re.fullmatch(r"\s*(?P<size>[0-9]+)\s+(?P<unit>\S+)\s*", text or "")
    return (int(form["size"]), unit_name(form["unit"])) if form else (1, "month")


def frame_times(first: dt.date, last: dt.date, unit: str, size: int) -> list[dt.date]:
    """Frame days from ``first`` up to ``last``, at least two of them."""
    unit, size = unit_name(unit, strict=False), max(1, int(size or 1))
    times = [first]
    while (following := step(times[-1], unit, size)) <= last:
        times.append(following)
    return times if len(times) > 1 else [first, following]
