"""Cron expressions: five fields, read once on the driver into sets of allowed values."""

from __future__ import annotations

from dataclasses import dataclass

# Names cron accepts, and the range of each field.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


@dataclass(frozen=True)
class Cron:
    times: tuple[int, ...]      # minutes of the day, ascending
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]    # 0 = Sunday
    either_day: bool            # day of month and weekday both restricted: one match is enough


def _number(text: str) -> int:
    name = text.lower()
    if name in MONTHS:
        return MONTHS.index(name) + 1
    if name in WEEKDAYS:
        return WEEKDAYS.index(name)
    return int(text)


def _field(text: str, low: int, high: int) -> frozenset[int]:
    values: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            first, last = low, high
        elif "-" in span:
            first, last = (_number(x) for x in span.split("-", 1))
        else:
            first = _number(span)
            last = high if step else first
        if not (low <= first <= last <= high):
            raise ValueError(f"cron field {text!r} is out of range")
        values.update(range(first, last + 1, int(step or 1)))
    return frozenset(values)


def parse_cron(text: str) -> Cron:
    fields = text.split()
    if len(fields) != 5:
        raise ValueError(f"cron expression needs five fields: {text!r}")
    minutes, hours, days, months, weekdays = (_field(f, *r) for f, r in zip(fields, RANGES))
    restricted = [not f.startswith("*") for f in fields]
    return Cron(tuple(sorted(60 * h + m for h in hours for m in minutes)), days, months,
                frozenset(d % 7 for d in weekdays), restricted[2] and restricted[4])
