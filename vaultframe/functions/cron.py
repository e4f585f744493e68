"""Cron schedules: built, parsed and described by expressions; next slots of any of them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sunday first, as reports write them. Fixed values.
DAY_NAMES = ("Paz", "Pzt", "Sal", "Çar", "Per", "Cum", "Cmt")
_NAMED = {"SUN": 0, "MON": 1, "TUE": 2, "WED": 3, "THU": 4, "FRI": 5, "SAT": 6}
_MONTHS = {m: i for i, m in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"), 1)}
#: Name and range of each field.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def build(days: Column, start: Column, end: Column, interval: Column) -> Column:
    """``0 hours * * days`` from an array of weekdays (Sunday 0) and a window of hours.

    Arguments out of range raise an error when the row is evaluated.
    """
    distinct = F.array_sort(F.array_distinct(days))
    bad = (F.size(distinct) == 0) | ~start.between(0, 23) | ~end.between(0, 23) | (end < start) | (interval < 1)
    hours = F.when(start == end, start.cast("string")).otherwise(F.concat(F.concat_ws("-", start.cast("string"), end.cast("string")), F.when(interval > 1, F.concat(F.lit("/"), interval.cast("string"))).otherwise("")))
    text = F.concat(F.lit("0 "), hours, F.lit(" * * "), F.when(F.size(distinct) == 7, "*").otherwise(F.array_join(distinct, ",")))
    return F.when(bad, F.raise_error(F.lit("days, hours or interval out of range")).cast("string")).otherwise(text)


def _parts(cron: Column) -> Column:
    return F.filter(F.split(F.coalesce(cron, F.lit("")), " "), lambda x: x != "")


def _day_numbers(field: Column) -> Column:
    """Weekday numbers of a list field, null if any part isn't one."""
    each = F.transform(F.split(field, ","), lambda x: x.try_cast("int"))
    return F.when(F.forall(each, lambda d: d.isNotNull() & d.between(0, 6)), F.array_sort(each))


def parse_simple(cron: Column) -> Column:
    """(days, start_hour, end_hour, interval_hours) if ``build`` could have made the text."""
    p = _parts(cron)
    shape = (F.size(p) == 5) & (F.get(p, F.lit(0)) == "0") & (F.get(p, F.lit(2)) == "*") & (F.get(p, F.lit(3)) == "*")
    step, field = F.split(F.get(p, F.lit(1)), "/"), F.get(p, F.lit(4))
    span = F.split(F.get(step, F.lit(0)), "-")
    number = lambda a, i: F.get(a, F.lit(i)).try_cast("int")
    start, single = number(span, 0), F.size(span) == 1
    end = F.when(single, start).otherwise(number(span, 1))
    every = F.when(single, F.lit(24)).when(F.size(step) == 1, F.lit(1)).otherwise(number(step, 1))
    days = F.when(field == "*", F.sequence(F.lit(0), F.lit(6))).otherwise(F.array_distinct(_day_numbers(field)))
    ok = shape & (F.size(step) <= 2) & (F.size(span) <= 2) & start.between(0, 23) & end.between(0, 23) & (end >= start) & (every >= 1) & ~(single & (F.size(step) > 1)) & days.isNotNull()
    return F.when(ok, F.struct(days.alias("days"), start.alias("start_hour"), end.alias("end_hour"), every.alias("interval_hours")))


def describe(cron: Column) -> Column:
    """Words for simple schedules, the text itself for others, a dash for none."""
    p = _parts(cron)
    shape = (F.size(p) == 5) & (F.get(p, F.lit(0)) == "0") & (F.get(p, F.lit(2)) == "*") & (F.get(p, F.lit(3)) == "*")
    hour_field, field = F.get(p, F.lit(1)), F.get(p, F.lit(4))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    step, one = F.split(hour_field, "/"), hour_field.try_cast("int")
    span = F.split(F.get(step, F.lit(0)), "-")
    lo, hi, every = F.get(span, F.lit(0)).try_cast("int"), F.get(span, F.lit(1)).try_cast("int"), F.get(step, F.lit(1)).try_cast("int")
    window = F.when((F.size(span) == 2) & (F.size(step) <= 2), F.concat(two(lo), F.lit(":00–"), two(hi), F.lit(":00 arası")))
    hours = F.when(one.isNotNull(), F.when(one.between(0, 23), F.concat(F.lit("saat "), two(one), F.lit(":00")))).when(F.size(step) == 1, F.concat(window, F.lit(" saat başı"))).otherwise(F.concat(window, F.lit(" "), every.cast("string"), F.lit(" saatte bir")))
    numbers = _day_numbers(field)
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    listed = F.array_join(F.transform(numbers, lambda d: F.get(names, d)), ", ")
    same = lambda *d: numbers == F.array(*[F.lit(x) for x in d])
    days = F.when(field == "*", "Her gün").when(same(1, 2, 3, 4, 5), "Hafta içi").when(same(0, 6), "Hafta sonu").when(F.size(numbers) == 7, "Her gün").otherwise(listed)
    return F.when(F.trim(F.coalesce(cron, F.lit(""))) == "", "—").when(~shape, cron).otherwise(F.coalesce(F.concat(days, F.lit(" "), hours), cron))


def expand(field: str, low: int, high: int) -> list[int]:
    """The values of one field: lists, ranges, steps, ``*`` and names. ValueError otherwise."""
    names = _NAMED if high == 7 else _MONTHS if high == 12 else {}
    value = lambda x: names[x.upper()] if x.upper() in names else int(x)
    out: set[int] = set()
    for part in field.split(","):
        body, slash, step = part.partition("/")
        every = int(step) if slash else 1
        if body == "*":
            a, b = low, high
        elif "-" in body:
            a, b = map(value, body.split("-"))
        else:
            a = value(body)
            b = high if slash else a
        if every < 1 or not low <= a <= b <= high:
            raise ValueError(f"bad cron field {field!r}")
        out.update(range(a, b + 1, every))
    return sorted({v % 7 for v in out} if high == 7 else out)


def fields(cron: str) -> dict[str, list[int]]:
    """Values of the five fields. If both day fields are given, both have to match."""
    parts = cron.split()
    if len(parts) != 5:
        raise ValueError(f"not a cron expression: {cron!r}")
    return {name: expand(part, low, high) for part, (name, low, high) in zip(parts, FIELDS, strict=True)}


#: Every date that a schedule can name comes up in so many years: leap days on each weekday,
#: also where a century has no leap year.
HORIZON_YEARS = 40


@lru_cache(10_000)
def _calendar(cron: str) -> tuple[tuple[int, ...], frozenset[int], frozenset[int], frozenset[int]]:
    """Minutes of a day, days, months and weekdays (Sunday 0)."""
    f = fields(cron)
    return tuple(60 * h + m for h in f["hour"] for m in f["minute"]), frozenset(f["day"]), frozenset(f["month"]), frozenset(f["weekday"])


def next_occurrence(cron: str, after: datetime) -> datetime | None:
    """The first slot after a time; None if the schedule never comes up, such as on 30
    February. ValueError if ``cron`` isn't one."""
    minutes, days, months, weekdays = _calendar(cron)
    day, i = after.date(), bisect_right(minutes, 60 * after.hour + after.minute)
    last = date(min(day.year + HORIZON_YEARS, 9999), 12, 31)
    while day <= last:
        if i < len(minutes) and day.month in months and day.day in days and day.isoweekday() % 7 in weekdays:
            return datetime(day.year, day.month, day.day) + timedelta(minutes=minutes[i])
        if day == last:
            return None
        day, i = day + timedelta(days=1), 0
    return None


def with_next(rows: DataFrame, cron: str, after: str, to: str = "next_slot") -> DataFrame:
    """``rows`` and ``to``: the first slot of the schedule in column ``cron`` after the time
    in column ``after``, without any horizon; null where either is null, where the text is
    no schedule, and where it never comes up.

    Each row computes its own, whatever the number of schedules; a worker remembers the
    fields of 10,000 of them.
    """
    names = [*rows.columns, to]
    at, when = names.index(cron), names.index(after)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{to}` timestamp_ntz"

    def one(c: str | None, t: datetime | None) -> datetime | None:
        try:
            return None if c is None or t is None else next_occurrence(c, t)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(c, t) for c, t in zip(batch.column(at).to_pylist(), batch.column(when).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.timestamp("us"))], names=names)

    return rows.mapInArrow(run, ddl)
