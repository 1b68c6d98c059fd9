"""Dates and times as Column expressions. Whatever depends on now takes it as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_to_ms(x: Column) -> Column:
    """Milliseconds since 1970 of an ISO time; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(x))


def timeline_key(x: Column) -> Column:
    """A key to sort dates by: YYYY-MM-DD, DD.MM.YYYY or a bare year; null for anything else."""
    german = F.regexp_replace(x, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10)).when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), german).when(x.rlike(r"^\d{4}$"), F.concat(x, F.lit("-00-00")))


def next_run(cron: Column, after: Column) -> Column:
    """The next time of a five-field schedule in one of five shapes (every minute, every n minutes, hourly, daily, weekly); otherwise a day later."""
    f = F.split(F.trim(cron), r"\s+")
    minute, hour, day, month, week = (F.get(f, F.lit(i)) for i in range(5))
    m, h, w, n = (F.try_to_number(x, F.lit("99")).cast("int") for x in (minute, hour, week, F.regexp_extract(minute, r"^\*/(\d+)$", 1)))
    start = F.date_trunc("minute", after)
    epoch = F.unix_timestamp(start)
    free = (day == "*") & (month == "*")
    at_day = F.date_trunc("day", after) + F.make_dt_interval(F.lit(0), h, m)
    at_hour = F.date_trunc("hour", after) + F.make_dt_interval(F.lit(0), F.lit(0), m)
    later = lambda t, step: F.when(t > after, t).otherwise(t + F.expr(f"INTERVAL {step}"))
    days = F.pmod(w - (F.dayofweek(after) - 1), F.lit(7))
    at_week = at_day + F.make_dt_interval(days)
    return (
        F.when(free & (minute == "*") & (hour == "*") & (week == "*"), start + F.expr("INTERVAL 1 MINUTE"))
        .when(free & n.isNotNull() & (hour == "*") & (week == "*"), F.timestamp_seconds((F.floor(epoch / (n * 60)) + 1) * n * 60).cast("timestamp_ntz"))
        .when(free & m.isNotNull() & (hour == "*") & (week == "*"), later(at_hour, "1 HOUR"))
        .when(free & m.isNotNull() & h.isNotNull() & (week == "*"), later(at_day, "1 DAY"))
        .when(free & m.isNotNull() & h.isNotNull() & w.isNotNull(), later(at_week, "7 DAY"))
        .otherwise(after + F.expr("INTERVAL 1 DAY"))
    )
