"""The indicators per group.  Each takes enriched messages and returns one row per group that has something to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions.service_time import age_to_severity, ratio_severity, service_minutes, wall_minutes
from .lanes import Scan, running
from .replies import is_ask, with_replies, within_cap


def unanswered(messages: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Customer asks after which no staff message comes, with age and severity."""
    staff = Scan("max", F.when(F.col("role") == "staff", F.col("seq")))
    open_ = running(messages, {"_staff_after": staff}, key, backwards=True).filter(is_ask() & F.col("_staff_after").isNull()).drop("_staff_after")
    open_ = open_.withColumn("age_min", service_minutes(F.col("ts"), now, cfg))
    return open_.withColumn("severity", age_to_severity(F.col("age_min"), cfg.i1_warn, cfg.i1_crit))


def i1(messages: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    return unanswered(messages, now, cfg, key).groupBy(key).agg(F.max("severity").alias("i1_severity"), F.count("*").cast("int").alias("i1_open_questions"), F.max("age_min").alias("i1_oldest_age_min"))


def latencies(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Business minutes from each ask to its first reply, unless the cap is passed on the way."""
    asked = with_replies(messages, key).filter(is_ask() & F.col("answered") & within_cap(cfg.i2_cap_days))
    return asked.withColumn("latency_min", service_minutes(F.col("ts"), F.col("reply_ts"), cfg))


def i2(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Nearest rank: of n sorted latencies the one with int(0.9 n) before it.

    Selected from counts: latencies are whole minutes below the cap, so a group has few different ones however many replies it has, and counts
    are made before the shuffle; the rank falls on the first value whose running count passes it."""
    counts = latencies(messages, cfg, key).groupBy(key, "latency_min").agg(F.count("*").alias("_c"))
    values = Window.partitionBy(key).orderBy("latency_min").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("_upto", F.sum("_c").over(values)).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    place = F.least(F.floor(F.col("_n") * 9 / 10), F.col("_n") - 1)
    p90 = rows.filter((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place))
    return p90.select(key, F.col("latency_min").alias("i2_p90_min"), age_to_severity(F.col("latency_min"), cfg.i2_warn, cfg.i2_crit).alias("i2_severity"), F.col("_n").cast("int").alias("i2_replies"))


def i4(messages: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    recent = messages.filter((F.col("role") == "customer") & (F.col("ts") >= now - F.expr(f"interval {cfg.i4_hours} hours")) & ~F.col("is_sticker"))
    ratio = F.count_if(F.coalesce("sentiment", F.lit(0.0)) < cfg.negative_below) / F.count("*")
    return recent.groupBy(key).agg(ratio.alias("i4_neg_ratio")).withColumn("i4_severity", ratio_severity(F.col("i4_neg_ratio")))


def i5(messages: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    return messages.groupBy(key).agg(F.count_if(F.col("ts") >= now - F.expr(f"interval {cfg.i5_hours} hours")).cast("int").alias("i5_msg_count_24h"))


def tripwire_events(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """Escalating messages, of any role and time, in order."""
    reason = F.concat(F.lit("升級詞觸發 (msg_id="), F.col("msg_id"), F.lit("): "), F.substring("text", 1, 30))
    return messages.filter("is_escalation_marker").select(key, "seq", reason.alias("reason"))


def negative_examples(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key", most: int = 3) -> DataFrame:
    """The first few negative customer messages of each group (only as many leave each task)."""
    w = Window.partitionBy(key).orderBy("seq")
    found = messages.filter((F.col("role") == "customer") & (F.coalesce("sentiment", F.lit(0.0)) < cfg.negative_below) & ~F.col("is_sticker"))
    return found.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= most).select(key, "ord", "ts", F.substring("text", 1, 80).alias("text"))


def latency_example(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """The first ask that any staff message follows, and that message."""
    w = Window.partitionBy(key).orderBy("seq")
    found = with_replies(messages, key).filter(is_ask() & ~F.col("is_sticker") & F.col("answered"))
    found = found.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return found.select(key, "ts", F.substring("text", 1, 80).alias("text"), "reply_ts", F.substring("reply_text", 1, 80).alias("reply_text"), wall_minutes(F.col("ts"), F.col("reply_ts")).alias("minutes"))
