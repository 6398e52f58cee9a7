"""Dates, editorial calendars and windows. Korean time is UTC+9 all year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_KST = 9


def kst(at: Column) -> Column:
    return at + F.make_dt_interval(hours=F.lit(HOURS_KST))


def weekday(day: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(day) - 1


def editorial_day(day: Column) -> Column:
    """Tuesday, Thursday, and Saturday of even ISO weeks."""
    return weekday(day).isin(2, 4) | ((weekday(day) == 6) & (F.weekofyear(day) % 2 == 0))


def business_days(days: DataFrame, holidays: DataFrame, name: str) -> DataFrame:
    """Without weekends and holidays."""
    return days.where(~weekday(F.col(name)).isin(0, 6)).join(F.broadcast(holidays), name, "left_anti")  # a calendar's holidays


def next_business_day(days: DataFrame, holidays: DataFrame, name: str, out: str = "next") -> DataFrame:
    """The first business day after each of ``days``, within 14."""
    later = days.select(name).distinct().withColumn(out, F.explode(F.sequence(F.date_add(name, 1), F.date_add(name, 14))))
    open_ = business_days(later, holidays.select(F.col(holidays.columns[0]).alias(out)), out)
    return days.join(open_.groupBy(name).agg(F.min(out).alias(out)), name, "left")


def due_days(day: Column, back: int = 7) -> Column:
    """Editorial days of the week before."""
    return F.filter(F.sequence(F.date_sub(day, back), F.date_sub(day, 1)), editorial_day)


def budget_window(at: Column) -> tuple[Column, Column]:
    """UTC starts of the Korean day and month of a moment."""
    back = F.make_dt_interval(hours=F.lit(HOURS_KST))
    return tuple(F.date_trunc(unit, kst(at)).cast("timestamp_ntz") - back for unit in ("day", "month"))


def cutoff(now: Column, days: Column) -> Column:
    """``days`` times 24 hours ago."""
    return now - F.make_dt_interval(hours=days.cast("int") * 24)


def lease_end(now: Column, seconds: Column, least: int = 60, most: int = 86_400) -> Column:
    return now + F.make_dt_interval(mins=F.lit(0), secs=F.greatest(F.lit(least), F.least(F.lit(most), seconds)).cast("decimal(18,6)"))


def deadline(at: Column) -> Column:
    """M/d, with the time where it isn't midnight."""
    day = F.concat(F.month(at), F.lit("/"), F.dayofmonth(at))
    return F.when(F.date_format(at, "HH:mm") == "00:00", day).otherwise(F.concat(day, F.lit(" "), F.date_format(at, "HH:mm")))


def slot(day: Column, hour: int) -> Column:
    """UTC moment of an hour of a Korean day."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour - HOURS_KST))


def korean_stamp(date: Column, time: Column, otherwise: str = "00:00:00") -> Column:
    """yyyyMMdd and HHmm or HHmmss (digits among anything) as a timestamp of +09:00 in text; null without a date of eight digits."""
    d = F.regexp_replace(F.coalesce(time, F.lit("")), "[^0-9]", "")
    seconds = F.coalesce(F.nullif(F.substring(d, 5, 2), F.lit("")), F.lit("00"))
    clock = F.when(F.length(d) >= 4, F.concat_ws(":", F.substring(d, 1, 2), F.substring(d, 3, 2), seconds)).otherwise(otherwise)
    return F.when(date.rlike("^[0-9]{8}$"), F.concat(F.substring(date, 1, 4), F.lit("-"), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2), F.lit("T"), clock, F.lit("+09:00")))


def parsed(text: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), otherwise)


def runs(df: DataFrame, key: str, at: str) -> DataFrame:
    """Adds ``previous``: the moment before it of the same key."""
    return df.withColumn("previous", F.lag(at).over(Window.partitionBy(key).orderBy(at)))
