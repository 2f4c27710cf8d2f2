"""Asks and the staff messages that answer them, as one-pass scans over a group's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.service_time import micros
from .lanes import Scan, running


def is_ask() -> Column:
    return (F.col("role") == "customer") & F.col("dialogue_act").isin("question", "request")


def with_replies(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """Adds answered, reply_seq, reply_ts, reply_text (first staff message after this one) and furthest_ts (latest time up to it).

    A block is what stands between two staff messages, with the later of them; a pass backwards carries a block's end and its latest time."""
    staff = F.col("role") == "staff"
    out = running(messages, {"_block": Scan("sum", F.when(staff, 1).otherwise(0).cast("long"))}, key)
    end = F.when(staff, F.struct("seq", "ts", "text"))
    out = running(out, {"_end": Scan("last", end), "furthest_ts": Scan("max", F.col("ts"))}, key, within="_block", backwards=True)
    return out.select(*messages.columns, F.col("_end").isNotNull().alias("answered"), *(F.col(f"_end.{c}").alias(f"reply_{c}") for c in ("seq", "ts", "text")), "furthest_ts")


def within_cap(days: int) -> Column:
    """No message up to the reply is `days` or more full days after the ask."""
    return micros(F.col("ts"), F.col("furthest_ts")) < days * 86_400_000_000
