"""Dividend and earnings calendars: events with either date in a window."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscan.functions import fields as C
from finscan.functions.fields import q
from finscan.functions.predicates import apply_filters
from finscan.plans.spec import Filter

DATES = {"dividends": ("dividend_ex_date_recent", "dividend_ex_date_upcoming"), "earnings": ("earnings_release_date", "earnings_release_next_date")}
DEFAULTS = {"dividends": C.DIVIDEND_CALENDAR, "earnings": C.EARNINGS_CALENDAR}
DAY = 86400


def default_window(now: datetime | None = None) -> tuple[int, int]:
    """Seven days: from three days before today's midnight (UTC) to the end of the third day after."""
    seconds = int((now or datetime.now(UTC)).timestamp())
    midnight = seconds - seconds % DAY
    return midnight - 3 * DAY, midnight + 3 * DAY + DAY - 1


def calendar(events: DataFrame, kind: str, start: int | None = None, end: int | None = None, markets=None, values=None, *, now: datetime | None = None, compat_drop_falsy: bool = False) -> DataFrame:
    """full_symbol and the asked fields of events with either date from start to end (epoch seconds, inclusive).

    Rows without a symbol are dropped. With compat_drop_falsy zeros and empty strings of the default
    fields become null.
    """
    C.checked(kind, DATES, "calendar")
    names = list(values or DEFAULTS[kind])
    if not C.all_known(names, DEFAULTS[kind]):
        raise ValueError(f"unknown calendar fields {sorted(set(names) - set(DEFAULTS[kind]))}")
    low, high = default_window(now)
    dates = tuple(d for d in DATES[kind] if d in events.columns)
    rows = apply_filters(events, (Filter(dates, "in_range", [start if start is not None else low, end if end is not None else high]),))
    if markets:
        rows = rows.where(q("market").isin(list(markets)))
    rows = rows.where(q("full_symbol").isNotNull() & (q("full_symbol") != ""))

    def column(name: str):
        text = name in C.TEXT_FIELDS
        c = q(name) if name in events.columns else F.lit(None).cast("string" if text else "double")
        if compat_drop_falsy and not values:
            c = F.nullif(c, F.lit("") if text else F.lit(0))
        return c.alias(name)

    return rows.select("full_symbol", *map(column, names))
