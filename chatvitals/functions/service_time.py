"""Business time in closed form, and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Vitals

MONDAY = "timestamp_ntz'1970-01-05 00:00:00'"


def in_service(ts: Column, cfg: Vitals = Vitals()) -> Column:
    return (F.weekday(ts) < cfg.service_days) & (F.hour(ts) >= cfg.service_open) & (F.hour(ts) < cfg.service_close)


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def service_minutes(start: Column, end: Column, cfg: Vitals = Vitals()) -> Column:
    """How many of start, start + 1 min, ... before end are in service; 0 if end is not after start."""
    day = (cfg.service_close - cfg.service_open) * 60

    def until(m: Column) -> Column:  # service minutes between the first Monday and minute m
        d, r = F.floor(F.pmod(m, F.lit(10080)) / 1440), F.pmod(m, F.lit(1440))
        today = F.when(d < cfg.service_days, F.least(F.lit(day), F.greatest(F.lit(0), r - cfg.service_open * 60))).otherwise(F.lit(0))
        return F.floor(m / 10080) * (day * cfg.service_days) + F.least(d, F.lit(cfg.service_days)) * day + today

    us = micros(start, end)
    steps = F.floor((us + 59_999_999) / 60_000_000)
    first = F.floor(micros(F.expr(MONDAY), start) / 60_000_000)
    return F.when(us > 0, (until(first + steps) - until(first)).cast("double")).otherwise(F.lit(0.0))


def age_to_severity(minutes: Column, warn: float, crit: float) -> Column:
    return F.when(minutes < warn, 0.0).when(minutes >= crit, 1.0).otherwise((minutes - warn) / (crit - warn))


def ratio_severity(ratio: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 0.1) / 0.5))


def wall_minutes(start: Column, end: Column) -> Column:
    return F.floor(micros(start, end) / 60_000_000)
