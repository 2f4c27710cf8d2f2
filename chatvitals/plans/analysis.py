"""From messages to ranked groups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions.rules import enrich
from ..held import once, spread  # noqa: F401
from ..operators import entropy, indicators, issues, lanes
from ..operators.merge import merge_fragments

DEFAULTS = {
    "i1_severity": 0.0, "i1_open_questions": 0, "i1_oldest_age_min": 0.0, "i2_severity": 0.0, "i2_p90_min": 0.0, "i4_severity": 0.0, "i4_neg_ratio": 0.0,
    "i5_msg_count_24h": 0, "i6_mean_entropy": 0.0, "i6_entropy_slope": 0.0, "i6_peak_entropy_frac": 0.5, "i6_points": 0,
}


def clock(now: datetime) -> Column:
    """`now` as a timestamp without zone; an aware one is refused, as message times have no zone."""
    if now.tzinfo is not None:
        raise ValueError("now must not carry a time zone")
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def prepare(messages: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    """Merged, enriched messages; giant groups come in lanes."""
    return enrich(merge_fragments(lanes.assign(messages, cfg.lane_rows), cfg), cfg)


def composite(cfg: Vitals = Vitals()) -> Column:
    w = cfg.weights
    score = F.lit(w["i1"]) * F.col("i1_severity") + F.lit(w["i2"]) * F.col("i2_severity") + F.lit(w.get("i3", 0.0)) * F.col("i3_severity") + F.lit(w["i4"]) * F.col("i4_severity")
    return F.when(F.col("tripwire"), F.greatest(score, F.lit(cfg.tripwire_score))).otherwise(score)


def tripwire_reasons(messages: DataFrame, one: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(group, tripwire_reasons): escalations in order, then the age of the oldest open ask."""
    said = indicators.tripwire_events(messages, key)
    aged = one.filter(F.col("i1_oldest_age_min") >= cfg.tripwire_age).select(key, F.lit((1 << 63) - 1).alias("seq"), F.concat(F.lit("未回應提問超過8業務小時 ("), F.bround("i1_oldest_age_min").cast("long").cast("string"), F.lit("分鐘)")).alias("reason"))
    rows = said.unionByName(aged)
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "reason"))), lambda r: r["reason"]).alias("tripwire_reasons"))


def group_metrics(messages: DataFrame, now: Column, groups: DataFrame | None = None, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """One row per group of `groups` (default: the groups of the messages), from merged and enriched messages.

    The messages are prepared once; every part is keyed by the group, so windows and joins reuse their partitioning."""
    messages = once(messages)
    groups = messages.select(key).distinct() if groups is None else groups
    one = indicators.i1(messages, now, cfg, key)
    series = entropy.entropy_series(messages, cfg, key)
    fracs = entropy.escalation_fracs(messages, key).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frac"))), lambda r: r["frac"]).alias("i6_escalation_fracs"))
    out = groups
    for part in (one, indicators.i2(messages, cfg, key).drop("i2_replies"), indicators.i4(messages, now, cfg, key), indicators.i5(messages, now, cfg, key), entropy.i6(series, key), fracs, tripwire_reasons(messages, one, cfg, key)):
        out = out.join(part, key, "left")
    out = out.fillna({k: v for k, v in DEFAULTS.items()})
    out = out.withColumns({"i6_escalation_fracs": F.coalesce("i6_escalation_fracs", F.array().cast("array<double>")), "tripwire_reasons": F.coalesce("tripwire_reasons", F.array().cast("array<string>"))})
    out = out.withColumns({"tripwire": F.size("tripwire_reasons") > 0, "i3_severity": F.lit(0.0), "i3_oldest_age_min": F.lit(0.0), "i3_open_issues": F.lit(0), "computed_at": now})
    return out.withColumn("composite", composite(cfg))


def with_issues(metrics: DataFrame, found: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Metrics with I3 from issues, and the composite recomputed."""
    return metrics.drop("i3_severity", "i3_oldest_age_min", "i3_open_issues").join(issues.i3(found, now, cfg, key), key, "left").fillna({"i3_severity": 0.0, "i3_oldest_age_min": 0.0, "i3_open_issues": 0}).withColumn("composite", composite(cfg))


#: Ranges of a ranking, and rows of the sample that splits them.
RANGES, SAMPLE = 128, 4096


def ranked(metrics: DataFrame, order: str = "group_key", key: str = "group_key") -> DataFrame:
    """Adds rank: tripwire groups first, then by score; ties by `order`.

    A row's rank is its place in its range after the rows of the ranges before.  Ranges lie between splitters, which a sample of about SAMPLE rows
    gives; the sample bears on their sizes only.  A row's range follows from the row and the splitters alone, so a part that is computed again has
    the same ranges and ranks.  No task sees all groups."""
    metrics = once(metrics)
    slim = metrics.select(*dict.fromkeys((key, "tripwire", "composite", order)))
    place = F.struct((~F.col("tripwire")).alias("calm"), (-F.col("composite")).alias("score"), F.col(order).alias("tie"))
    step = max(1, slim.count() // SAMPLE)
    sample = slim.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(place.alias("p")).orderBy("p").collect()
    cuts = [r.p for r in sample[:: max(1, len(sample) // RANGES)]][1:]
    kind = slim.select(place.alias("p")).schema["p"].dataType.simpleString()
    splitters = F.array(*(F.struct(F.lit(c.calm).alias("calm"), F.lit(c.score).alias("score"), F.lit(c.tie).alias("tie")) for c in cuts)).cast(f"array<{kind}>")
    slim = slim.withColumn("_range", F.size(F.filter(splitters, lambda c: c <= place)))
    sizes = slim.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("tripwire"), F.desc("composite"), F.asc(order)))
    ranks = slim.withColumn("_place", inside).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return metrics.join(ranks.select(key, (F.col("_before") + F.col("_place")).cast("int").alias("rank")), key)


def overview(metrics: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    watch = ~F.col("tripwire") & (F.col("composite") >= cfg.watch)
    return metrics.agg(F.count("*").alias("total"), F.count_if("tripwire").alias("red"), F.count_if(watch).alias("watch"), F.count_if(~F.col("tripwire") & (F.col("composite") < cfg.watch)).alias("ok"))


def overview_names(ranked_metrics: DataFrame, cfg: Vitals = Vitals(), name: str = "group_id") -> DataFrame:
    """(kind, rank, name) of red and of ok groups; whoever shows them joins them in the order of rank."""
    kind = F.when(F.col("tripwire"), "red").when(F.col("composite") >= cfg.watch, "watch").otherwise("ok")
    return ranked_metrics.select(kind.alias("kind"), "rank", F.col(name).cast("string").alias("name")).filter("kind <> 'watch'")
