"""Five-field cron expressions: previous and next slot (UTC)."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
NAMES = {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}
#: Slots are looked for this many days each way; a leap day comes within eight years.
HORIZON = 8 * 366


def _values(field: str, low: int, high: int) -> frozenset[int]:
    out = set()
    for part in field.lower().split(","):
        span, _, step = part.partition("/")
        a, b = low, high
        if span != "*":
            left, _, right = span.partition("-")
            number = lambda t: NAMES[t] if t in NAMES else int(t)
            a = number(left)
            b = number(right) if right else (high if step else a)
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(field)
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


def parse(expression: str) -> tuple[frozenset[int], ...] | None:
    """Allowed values per field; null for ``manual`` and anything that is no expression."""
    fields = (expression or "").split()
    try:
        if len(fields) != 5:
            return None
        minute, hour, day, month, weekday = (_values(f, *r) for f, r in zip(fields, RANGES))
        return minute, hour, day, month, frozenset(d % 7 for d in weekday), fields[2] == "*", fields[4] == "*"
    except (KeyError, ValueError):
        return None


def _day_fits(d: datetime, cron) -> bool:
    _, _, day, month, weekday, any_day, any_weekday = cron
    if d.month not in month:
        return False
    by_day, by_week = d.day in day, d.isoweekday() % 7 in weekday
    if any_day or any_weekday:
        return by_day and by_week
    return by_day or by_week  # both restricted: either is enough


def slot(expression: str, at: datetime, forward: bool) -> datetime | None:
    """The next slot after ``at``, or the last one before it."""
    cron = parse(expression)
    if cron is None or at is None or pd.isna(at):
        return None
    times = sorted((h, m) for h in cron[1] for m in cron[0])
    for n in range(HORIZON + 1):
        date = (at + timedelta(days=n if forward else -n)).replace(hour=0, minute=0, second=0, microsecond=0)
        if not _day_fits(date, cron):
            continue
        for h, m in times if forward else reversed(times):
            found = date.replace(hour=h, minute=m)
            if found > at if forward else found < at:
                return found
    return None


@F.pandas_udf(T.TimestampType())
def previous_slot(expression: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([slot(e, a, forward=False) for e, a in zip(expression, at)], dtype="datetime64[ns]")


@F.pandas_udf(T.TimestampType())
def next_slot(expression: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([slot(e, a, forward=True) for e, a in zip(expression, at)], dtype="datetime64[ns]")
