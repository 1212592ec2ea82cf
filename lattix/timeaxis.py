"""Calendar arithmetic of the time axis, on the driver and as Spark columns.

A time is a datetime with a granularity; times compare and subtract in the coarser
granularity of the two. All times are without zone.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Unit(IntEnum):
    SECOND = 0
    MINUTE = 1
    HOUR = 2
    DAY = 3
    WEEK = 4
    MONTH = 5
    YEAR = 6


LETTER = {Unit.SECOND: "S", Unit.MINUTE: "M", Unit.HOUR: "H", Unit.DAY: "D", Unit.WEEK: "W", Unit.MONTH: "M", Unit.YEAR: "Y"}
SECONDS = {Unit.SECOND: 1, Unit.MINUTE: 60, Unit.HOUR: 3600}
DURATION = re.compile(r"P(T?)(\d+)([YMWDHS])\Z")
TIMESTAMP = re.compile(r"\s*(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?)?)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?\s*\Z")
DIGITS = re.compile(r"(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?\Z")


@dataclass(frozen=True)
class Duration:
    count: int
    unit: Unit

    @classmethod
    def parse(cls, text: str) -> Duration:
        m = DURATION.match(text.strip())
        if not m:
            raise ValueError(f"not a duration of one component: {text!r}")
        timed, count, letter = m[1] == "T", int(m[2]), m[3]
        units = {(u in SECONDS, LETTER[u]): u for u in Unit}
        if (timed, letter) not in units:
            raise ValueError(f"not a duration: {text!r}")
        return cls(count, units[timed, letter])

    def __str__(self) -> str:
        return f"P{'T' if self.unit in SECONDS else ''}{self.count}{LETTER[self.unit]}"

    def __mul__(self, n: int) -> Duration:
        return Duration(self.count * n, self.unit)

    def convert(self, unit: Unit) -> Duration:
        """In another unit, rounded up; months have 30 days and years 12 months."""
        seconds = {Unit.SECOND: 1, Unit.MINUTE: 60, Unit.HOUR: 3600, Unit.DAY: 86400, Unit.WEEK: 7 * 86400, Unit.MONTH: 30 * 86400, Unit.YEAR: 360 * 86400}
        return Duration(-(-self.count * seconds[self.unit] // seconds[unit]), unit)


@dataclass(frozen=True)
class Time:
    value: datetime
    unit: Unit

    @classmethod
    def parse(cls, text: str) -> Time:
        """From ISO-like text; the parts given set the unit. A zone is read and ignored."""
        m = TIMESTAMP.match(text)
        if not m:
            raise ValueError(f"not a datetime: {text!r}")
        return cls._of([p for p in m.groups() if p is not None])

    @classmethod
    def from_digits(cls, text: str) -> Time:
        """From digits alone: YYYY, YYYYmm, YYYYmmdd and so on; other characters are skipped."""
        m = DIGITS.match(re.sub(r"\D", "", text))
        if not m:
            raise ValueError(f"not a datetime: {text!r}")
        return cls._of([p for p in m.groups() if p is not None])

    @classmethod
    def _of(cls, parts: list[str]) -> Time:
        numbers = [int(p) for p in parts]
        unit = [Unit.YEAR, Unit.MONTH, Unit.DAY, Unit.HOUR, Unit.MINUTE, Unit.SECOND][len(numbers) - 1]
        return cls(datetime(*(numbers + [1, 1, 1][len(numbers) : 3])), unit)

    def truncate(self, unit: Unit) -> Time:
        """Fields finer than the unit at their start; a week keeps its day."""
        v = self.value.replace(microsecond=0)
        if unit >= Unit.YEAR:
            v = v.replace(month=1)
        if unit >= Unit.MONTH:
            v = v.replace(day=1)
        if unit >= Unit.DAY:
            v = v.replace(hour=0)
        if unit >= Unit.HOUR:
            v = v.replace(minute=0)
        if unit >= Unit.MINUTE:
            v = v.replace(second=0)
        return Time(v, unit)

    def end(self) -> Time:
        """The last second of the unit this time lies in (of its day for weeks)."""
        v = self.truncate(self.unit).value
        if self.unit == Unit.YEAR:
            v = v.replace(month=12)
        if self.unit >= Unit.MONTH:
            v = v.replace(day=calendar.monthrange(v.year, v.month)[1])
        if self.unit >= Unit.DAY:
            v = v.replace(hour=23)
        if self.unit >= Unit.HOUR:
            v = v.replace(minute=59)
        if self.unit >= Unit.MINUTE:
            v = v.replace(second=59)
        return Time(v, self.unit)

    def __add__(self, d: Duration) -> Time:
        v = self.value
        if d.unit >= Unit.MONTH:
            month = v.year * 12 + v.month - 1 + d.count * (12 if d.unit == Unit.YEAR else 1)
            year, month = divmod(month, 12)
            v = v.replace(year=year, month=month + 1, day=min(v.day, calendar.monthrange(year, month + 1)[1]))
        else:
            v += timedelta(days=d.count * (7 if d.unit == Unit.WEEK else 1)) if d.unit >= Unit.DAY else timedelta(seconds=d.count * SECONDS[d.unit])
        return Time(v, d.unit)

    def __sub__(self, other: Time) -> Duration:
        """The difference in the coarser unit; months and years count calendar fields."""
        unit = max(self.unit, other.unit)
        a, b = self.truncate(unit).value, other.truncate(unit).value
        if unit == Unit.YEAR:
            return Duration(a.year - b.year, unit)
        if unit == Unit.MONTH:
            return Duration((a.year - b.year) * 12 + a.month - b.month, unit)
        if unit >= Unit.DAY:
            days = (a.date() - b.date()).days
            return Duration(int(days / 7) if unit == Unit.WEEK else days, unit)
        return Duration(int((a - b).total_seconds()) // SECONDS[unit], unit)

    def number(self) -> float:
        """Digits of the fields down to the unit; weeks are coarser than days and give year and month."""
        v = self.value
        parts = [f"{v.year:04}", f"{v.month:02}", f"{v.day:02}", f"{v.hour:02}", f"{v.minute:02}", f"{v.second:02}"]
        keep = {Unit.YEAR: 1, Unit.MONTH: 2, Unit.WEEK: 2, Unit.DAY: 3, Unit.HOUR: 4, Unit.MINUTE: 5, Unit.SECOND: 6}[self.unit]
        return float("".join(parts[:keep]))

    def __str__(self) -> str:
        return self.value.strftime("%Y-%m-%d" if self.unit >= Unit.DAY else "%Y-%m-%dT%H:%M:%S")

    @property
    def day_of_week(self) -> int:
        """0 is Sunday."""
        return (self.value.weekday() + 1) % 7

    @property
    def day_of_year(self) -> int:
        return self.value.timetuple().tm_yday

    @property
    def epoch(self) -> int:
        return int((self.value - datetime(1970, 1, 1)).total_seconds())


def parse_time(value: str | datetime | Time) -> Time:
    if isinstance(value, Time):
        return value
    return Time(value.replace(microsecond=0), Unit.SECOND) if isinstance(value, datetime) else Time.parse(value)


def _ntz(value: datetime) -> Column:
    return F.to_timestamp_ntz(F.lit(value.strftime("%Y-%m-%d %H:%M:%S")))


def seconds_since(ts: Column, origin: datetime) -> Column:
    """Whole seconds from ``origin`` to a TIMESTAMP_NTZ column, free of session zones."""
    return F.timestamp_diff("SECOND", _ntz(origin), ts.cast("timestamp_ntz"))


@dataclass(frozen=True)
class RegularTime:
    """Slices of one duration from ``t0``; ``t1`` is the last instant."""

    t0: Time
    t1: Time
    dt: Duration

    @classmethod
    def by_duration(cls, start: str | Time, end: str | Time, dt: str | Duration) -> RegularTime:
        a, b = parse_time(start), parse_time(end)
        dt = Duration.parse(dt) if isinstance(dt, str) else dt
        if dt.count < 1:
            raise ValueError("dt must be at least one unit")
        coarse = max(a.unit, b.unit)
        a, b = a.truncate(coarse), b.truncate(coarse)
        if coarse > dt.unit:  # the bounds name whole units: from the first to the last instant
            a, b = Time(a.value, dt.unit), Time(b.end().value, dt.unit)
        else:
            a, b = a.truncate(dt.unit), b.truncate(dt.unit)
        total = (b - a).count + 1
        if total < 1:
            raise ValueError("the end lies before the start")
        if total % dt.count:
            b = a + dt * (total // dt.count) + Duration(dt.count - 1, dt.unit)
        if dt.unit == Unit.WEEK:
            return cls(a, b, dt)
        return cls(a.truncate(dt.unit), b.truncate(dt.unit).end(), dt)

    @classmethod
    def by_count(cls, start: str | Time, end: str | Time, n: int) -> RegularTime:
        a, b = parse_time(start), parse_time(end)
        coarse = max(a.unit, b.unit)
        a, b = a.truncate(coarse), b.truncate(coarse)
        total = (b - a).count + 1
        dt = Duration(-(-total // n), coarse)
        return cls(a, a + dt * (n - 1) if total % n else b, dt)

    @property
    def nt(self) -> int:
        if self.t0.value == self.t1.value:
            return 1
        return -(-((self.t1 - self.t0).count + 1) // self.dt.count)

    @property
    def unit(self) -> Unit:
        return self.dt.unit

    def at(self, it: int) -> Time:
        return self.t0 + self.dt * it

    def index(self, t: Time) -> int:
        """The slice a time lies in; before the start it is negative."""
        origin = Time(self.t0.value, self.unit)
        unit = max(t.unit, self.unit)
        if unit == Unit.WEEK:
            return ((t.truncate(Unit.DAY) - origin.truncate(Unit.DAY)).count) // (7 * self.dt.count)
        steps = (t.truncate(self.unit) - origin).count
        return steps // self.dt.count

    def labels(self) -> list[Time]:
        return [self.at(i) for i in range(self.nt)]

    def start_column(self, it: Column) -> Column:
        """The start of a slice as TIMESTAMP_NTZ."""
        return F.timestamp_add(self.unit.name, (it * self.dt.count).cast("int"), _ntz(self.t0.value))

    def index_column(self, ts: Column) -> Column:
        """The slice of a TIMESTAMP_NTZ column, by floor; out of range times give indices out of range."""
        ts, t0 = ts.cast("timestamp_ntz"), self.t0.value
        if self.unit == Unit.YEAR:
            steps = F.year(ts) - t0.year
        elif self.unit == Unit.MONTH:
            steps = F.year(ts) * 12 + F.month(ts) - (t0.year * 12 + t0.month)
        elif self.unit >= Unit.DAY:
            steps = F.datediff(ts.cast("date"), F.lit(t0.date()))
            if self.unit == Unit.WEEK:
                return F.floor(steps / (7 * self.dt.count)).cast("int")
        else:
            steps = F.floor(seconds_since(ts, t0) / SECONDS[self.unit])
        return F.floor(steps / self.dt.count).cast("int")

    def number_column(self, it: Column) -> Column:
        """``Time.number`` of a slice's start."""
        pattern = {Unit.YEAR: "yyyy", Unit.MONTH: "yyyyMM", Unit.WEEK: "yyyyMM", Unit.DAY: "yyyyMMdd", Unit.HOUR: "yyyyMMddHH", Unit.MINUTE: "yyyyMMddHHmm", Unit.SECOND: "yyyyMMddHHmmss"}[self.unit]
        return F.date_format(self.start_column(it), pattern).cast("double")

    def slice_of(self, first: int, last: int) -> RegularTime:
        """The axis of slices ``first`` to ``last``, which may reach beyond this one."""
        end = Time((self.at(last) + Duration(self.dt.count - 1, self.unit)).value, self.unit)
        return RegularTime(Time(self.at(first).value, self.unit), end if self.unit == Unit.WEEK else end.end(), self.dt)


@dataclass(frozen=True)
class LabeledTime:
    """Slices at listed times of one unit, in list order."""

    times: tuple[Time, ...]
    dt: Duration | None = None

    def __post_init__(self):
        if not self.times:
            raise ValueError("no time label")
        if len({t.value for t in self.times}) < len(self.times):
            raise ValueError("a time label repeats")

    @property
    def unit(self) -> Unit:
        return self.times[0].unit

    @property
    def nt(self) -> int:
        return len(self.times)

    @property
    def t0(self) -> Time:
        return self.times[0]

    @property
    def t1(self) -> Time:
        return self.times[-1]

    def at(self, it: int) -> Time:
        return self.times[it]

    def index(self, t: Time) -> int:
        wanted = t.truncate(self.unit).value
        for i, label in enumerate(self.times):
            if label.value == wanted:
                return i
        raise ValueError(f"no slice is labelled {t}")

    def labels(self) -> list[Time]:
        return list(self.times)

    def _lookup(self, it: Column, values: list) -> Column:
        return F.element_at(F.array(*values), it + 1)

    def start_column(self, it: Column) -> Column:
        """The label of a slice; NULL beyond the last."""
        return F.when(it.between(0, self.nt - 1), self._lookup(F.least(F.greatest(it, F.lit(0)), F.lit(self.nt - 1)), [_ntz(t.value) for t in self.times]))

    def index_column(self, ts: Column) -> Column:
        ts = ts.cast("timestamp_ntz")
        ts = F.date_trunc("DAY" if self.unit == Unit.WEEK else self.unit.name, ts).cast("timestamp_ntz")
        place = F.array_position(F.array(*[_ntz(t.value) for t in self.times]), ts)
        return F.when(place > 0, place - 1).cast("int")

    def number_column(self, it: Column) -> Column:
        return self._lookup(it, [F.lit(t.number()) for t in self.times])

    def slice_of(self, first: int, last: int) -> LabeledTime:
        if first < 0 or last >= self.nt:
            raise ValueError("labelled time cannot be extended")
        return LabeledTime(self.times[first : last + 1], self.dt)


TimeAxis = RegularTime | LabeledTime
