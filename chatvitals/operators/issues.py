"""Issues from an extractor: transcripts of gated groups, JSON replies, and the age of the oldest open issue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions.service_time import age_to_severity, micros

ISSUE = "issue_id string, raised_by string, raised_at string, summary string, type string, status string, resolution_evidence string, last_activity_at string, evidence_msg_ids array<string>"
#: evidence ids are read apart, so that one field of another shape does not spoil the rest
REPLY = f"struct<issues:array<struct<{', '.join(f.replace(' ', ':', 1) for f in ISSUE.split(', '))}>>, _bad:string>"


def transcripts(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """(group, transcript): a line per message, in order."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    who = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    body = F.when(F.col("is_sticker"), "[貼圖]").otherwise(F.col("text"))
    line = F.concat(F.lit("["), iso, F.lit("] ["), who("role", "unknown"), F.lit("] ["), F.col("msg_id"), F.lit("] "), who("sender", "?"), F.lit(": "), body)
    rows = F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))


def gate(metrics: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    """Groups worth an extraction."""
    return metrics.filter(F.col("tripwire") | (F.col("composite") >= cfg.gate))


def extract(texts: DataFrame, make_extractor: Callable[[], Callable[[str], str]], key: str = "group_key") -> DataFrame:
    """(group, reply, failure): the extractor is made once per worker and called once per group; one that raises gives a null reply and the
    text of its error.  Persist the result before using it twice."""

    def run(frames):
        call = make_extractor()
        for frame in frames:
            replies, failures = [], []
            for t in frame["transcript"]:
                reply = failure = None
                try:
                    reply = call(t)
                except Exception as e:  # noqa: BLE001 - one group's failure leaves the others alone
                    failure = f"{type(e).__name__}: {e}"
                replies.append(reply)
                failures.append(failure)
            yield frame[[key]].assign(reply=replies, failure=failures)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "transcript").mapInPandas(run, f"{key} {kind}, reply string, failure string")


def parse_replies(replies: DataFrame, key: str = "group_key") -> tuple[DataFrame, DataFrame]:
    """(issues, status): issues with their order and, as a VARIANT, all fields of the reply; status per group with error if the reply cannot be used (its group then keeps its numbers): the extractor's failure, if replies have it."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

    def read(c: Column) -> Column:
        return F.from_json(c, REPLY, options)

    inner = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    is_object = F.trim(F.col("reply")).rlike(r"(?s)^\s*\{.*\}\s*$")
    has_list = lambda c: F.coalesce(F.get_json_object(c, "$.issues").startswith("["), F.lit(False))
    absent = lambda c: F.get_json_object(c, "$.issues").isNull() & ~F.coalesce(c.rlike(r'"issues"\s*:'), F.lit(False))
    chosen = F.when(is_object, F.col("reply")).otherwise(inner)
    rows = replies.withColumn("_text", chosen).withColumn("_read", F.when(F.col("_text") != "", read(F.col("_text"))))
    broken = F.col("reply").isNull() | ((F.col("_text") != "") & (F.col("_read").isNull() | F.col("_read._bad").isNotNull() | ~(has_list(F.col("_text")) | absent(F.col("_text"))))) | F.trim("reply").rlike(r"^\[")
    rows = rows.withColumn("_broken", F.coalesce(broken, F.lit(True)))
    every = F.try_variant_get(F.try_parse_json("_text"), "$.issues", "array<variant>")
    issues = rows.filter("not _broken").select(key, every.alias("_every"), F.posexplode(F.coalesce("_read.issues", F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ISSUE.split(', '))}>>"))).alias("issue_ord", "i")).select(key, "issue_ord", "i.*", F.get("_every", F.col("issue_ord")).alias("fields"))
    # an open issue whose time is null spoils the reply
    spoiled = issues.filter(is_open() & F.col("raised_at").isNull()).select(key).distinct().withColumn("_spoiled", F.lit(True))
    issues = issues.join(spoiled, key, "left_anti")
    failure = F.col("failure") if "failure" in replies.columns else F.lit(None).cast("string")
    status = rows.join(spoiled, key, "left").select(key, F.when(F.col("_broken") | F.coalesce("_spoiled", F.lit(False)), F.coalesce(failure, F.lit("unusable reply"))).alias("error"))
    return issues, status


def other_fields() -> Column:
    """The fields of an issue that have no column, as a JSON object in the order of their names; null if there is none."""
    known = [f.split(" ")[0] for f in ISSUE.split(", ")]
    rest = F.map_filter(F.try_variant_get("fields", "$", "map<string,variant>"), lambda k, v: ~k.isin(known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def is_open() -> Column:
    return F.coalesce(F.col("status").isin("unresolved", "unclear"), F.lit(False))


def raised(c: Column) -> Column:
    """ISO time as TIMESTAMP_NTZ on the clock of UTC if it has a zone, else as it is; null if it cannot be read."""
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    plain = F.coalesce(c.try_cast("timestamp_ntz"), F.to_timestamp_ntz(F.when(c.rlike(r"^\d{8}T\d{6}$"), c), F.lit("yyyyMMdd'T'HHmmss")))
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.try_cast("timestamp").cast("timestamp_ntz"))).otherwise(plain)


def i3(issues: DataFrame, now: Column, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Oldest open issue (wall clock minutes) with severity, and how many are open."""
    age = F.when(is_open(), micros(raised(F.col("raised_at")), now) / 60_000_000.0)
    found = issues.groupBy(key).agg(F.greatest(F.lit(0.0), F.coalesce(F.max(age), F.lit(0.0))).alias("i3_oldest_age_min"), F.count_if(is_open()).cast("int").alias("i3_open_issues"))
    return found.withColumn("i3_severity", F.when(F.col("i3_oldest_age_min") <= 0, 0.0).otherwise(age_to_severity(F.col("i3_oldest_age_min"), cfg.i3_warn, cfg.i3_crit)))


def issue_order(issues: DataFrame) -> DataFrame:
    """Open issues, then resolved ones, each as they came; other states are left out."""
    shown = issues.filter(is_open() | (F.col("status") == "resolved"))
    return shown.withColumn("shown_ord", F.when(is_open(), 0).otherwise(1))
