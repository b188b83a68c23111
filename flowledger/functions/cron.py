"""Cron expressions of six fields, descriptors and fixed intervals; times are UTC milliseconds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import duration_ms

# Fixed values.
FIELDS = [("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day-of-month", 1, 31), ("month", 1, 12), ("day-of-week", 0, 6)]
DESCRIPTORS = {
    "@yearly": "0 0 0 1 1 *", "@annually": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 0", "@daily": "0 0 0 * * *", "@midnight": "0 0 0 * * *", "@hourly": "0 0 * * * *",
}
NAMES = {
    "month": {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    "day-of-week": {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())},
}
LONGEST_DAYS = 4 * 365


@dataclass(frozen=True)
class Cron:
    sets: tuple[frozenset[int], ...] = ()
    any_day: bool = True
    any_weekday: bool = True
    every_ms: int | None = None

    def day_matches(self, t: datetime) -> bool:
        day, weekday = t.day in self.sets[3], t.isoweekday() % 7 in self.sets[5]
        return day or weekday if not self.any_day and not self.any_weekday else day and weekday


def _number(text: str, field: str, low: int, high: int) -> int:
    value = NAMES.get(field, {}).get(text.lower(), text)
    if not str(value).isdigit() or not low <= int(value) <= high:
        raise ValueError(f"bad {field}: {text}")
    return int(value)


def _field(text: str, field: str, low: int, high: int) -> frozenset[int]:
    """Lists of ``*``, ``?``, n, a-b, each with a step perhaps; ``n/step`` is just n."""
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        if step and (not step.isdigit() or int(step) == 0):
            raise ValueError(f"bad {field} step: {part}")
        if body in ("*", "?"):
            first, last = low, high
        else:
            a, dash, b = body.partition("-")
            first = _number(a, field, low, high)
            last = _number(b, field, low, high) if dash else first
            if last < first:
                raise ValueError(f"bad {field} range: {part}")
        out.update(range(first, last + 1, int(step or 1)))
    return frozenset(out)


def parse(text: str, timezone_name: str = "UTC") -> Cron:
    if timezone_name not in ("UTC", "Etc/UTC"):
        raise ValueError(f"only UTC is supported, not {timezone_name}")
    text = text.strip()
    if text.startswith("@every "):
        ms = duration_ms(text[7:].strip())
        if ms <= 0:
            raise ValueError("an interval must be a millisecond at least")
        return Cron(every_ms=ms)
    if text.startswith("@"):
        if text not in DESCRIPTORS:
            raise ValueError(f"unknown descriptor: {text}")
        text = DESCRIPTORS[text]
    parts = text.split()
    if len(parts) != 6:
        raise ValueError(f"six fields are needed: {text}")
    sets = tuple(_field(p, *f) for p, f in zip(parts, FIELDS))
    return Cron(sets, parts[3] in ("*", "?"), parts[5] in ("*", "?"))


def next_after(cron: Cron, ms: int) -> int:
    """The first time strictly after ``ms``; ValueError if there is none in four years."""
    if cron.every_ms:
        return ms + cron.every_ms
    t = datetime.fromtimestamp(ms // 1000 + 1, timezone.utc)
    end = t + timedelta(days=LONGEST_DAYS)
    while t <= end:
        if t.month not in cron.sets[4] or not cron.day_matches(t):
            t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
        elif t.hour not in cron.sets[2]:
            t = (t + timedelta(hours=1)).replace(minute=0, second=0)
        elif t.minute not in cron.sets[1]:
            t = (t + timedelta(minutes=1)).replace(second=0)
        elif t.second not in cron.sets[0]:
            t += timedelta(seconds=1)
        else:
            return int(t.timestamp()) * 1000
    raise ValueError("no such time within four years")


def matches(cron: Cron, at: Column) -> Column:
    """Whether a timestamp of whole seconds is one of the expression's."""
    parts = [F.second(at), F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1]
    hit = [p.isin(*sorted(s)) for p, s in zip(parts, cron.sets)]
    days = (hit[3] | hit[5]) if not cron.any_day and not cron.any_weekday else hit[3] & hit[5]
    return hit[0] & hit[1] & hit[2] & hit[4] & days


def due_between(spark: SparkSession, cron: Cron, from_ms: int, to_ms: int) -> DataFrame:
    """fire_ms in (from, to]: days are listed and filtered first, then hours, minutes and seconds of the sets."""
    if cron.every_ms:
        return spark.range(from_ms + cron.every_ms, to_ms + 1, cron.every_ms).select(F.col("id").alias("fire_ms"))
    day = 86_400
    days = spark.range(from_ms // 1000 // day, to_ms // 1000 // day + 1).select((F.col("id") * day).alias("day"))
    only_day = Cron((frozenset({0}), frozenset({0}), frozenset({0}), *cron.sets[3:]), cron.any_day, cron.any_weekday)
    days = days.where(matches(only_day, F.timestamp_seconds("day")))
    clock = [F.explode(F.lit(sorted(s))) for s in cron.sets[:3]]
    every = days.select("day", clock[2].alias("h")).select("day", "h", clock[1].alias("m")).select("day", "h", "m", clock[0].alias("s"))
    return every.select(((F.col("day") + F.col("h") * 3600 + F.col("m") * 60 + F.col("s")) * 1000).alias("fire_ms")).where((F.col("fire_ms") > from_ms) & (F.col("fire_ms") <= to_ms))


def reconcile(spark: SparkSession, name: str, cron: Cron, floor_ms: int, now_ms: int, existing: DataFrame) -> DataFrame:
    """Scheduled workflows still to start: fire times since ``floor_ms`` whose id is not there yet."""
    due = due_between(spark, cron, floor_ms, now_ms).withColumn("workflow_uuid", F.concat(F.lit(f"sched-{name}-"), F.col("fire_ms").cast("string")))
    return due.join(existing, "workflow_uuid", "left_anti")
