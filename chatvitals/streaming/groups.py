"""Growing exports as a stream: each group has state, updated by the lines that come, and is scored again whenever it grows.

Pieces of an export are files `NAME@N.txt` with consecutive whole lines, N rising.  Lines are parsed and staff are looked up by DataFrame expressions;
one stateful operator per group carries the date, the open message, the asks without a reply, the counts of latencies, the counts of the last days, the
texts of the entropy window and the running sums of the entropy series.  After any number of pieces the metrics are those of the batch analysis of
the lines so far; how they were cut does not matter.

State grows with a group's open asks, different latencies (bounded by the cap), times of the last days, and one number per text message, kept in blocks, as
it is only read at two places.  With `refresh` a timer scores a group again although nothing came, as asks grow older.

A piece that is not UTF-8, an impossible date or time, or a piece out of order fails its group, as a file fails as a whole in the batch
analysis."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import Vitals
from ..functions.service_time import age_to_severity, ratio_severity
from ..functions.text import lines
from ..operators.entropy import Multiset
from ..plans.analysis import composite
from ..sources import exports

MINUTE, DAY = 60_000_000, 86_400_000_000
#: The first Monday of Unix time.
MONDAY = 4 * DAY
#: Running sums that are kept together.
BLOCK = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def service_minutes(start: int, end: int, cfg: Vitals) -> float:
    """functions.service_time.service_minutes for microseconds."""
    day = (cfg.service_close - cfg.service_open) * 60

    def until(m: int) -> int:
        d, r = m % 10080 // 1440, m % 1440
        today = min(day, max(0, r - cfg.service_open * 60)) if d < cfg.service_days else 0
        return m // 10080 * day * cfg.service_days + min(d, cfg.service_days) * day + today

    if end <= start:
        return 0.0
    first = (start - MONDAY) // MINUTE
    return float(until(first - (start - end) // MINUTE) - until(first))


def tags(text: str, special: bool, cfg: Vitals) -> tuple[str, float, bool]:
    """functions.rules.enrich for one message: act, sentiment, escalation."""
    t = text.strip()
    found = lambda patterns: any(re.search(p, t) for p in patterns)
    act = "answer"
    if special:
        act = "ack"
    elif not t:
        act = "chit_chat"
    else:
        for name, patterns in (("ack", cfg.ack), ("question", cfg.question), ("request", cfg.request), ("report", cfg.complaint), ("chit_chat", cfg.chit_chat)):
            if found(patterns):
                act = name
                break
    pos, neg = (sum(w in text for w in words) for words in (cfg.positive, cfg.negative))
    return act, (pos - neg) / (pos + neg) if pos + neg else 0.0, any(w in text for w in cfg.escalation)


class Group:
    """What is known of a group; running sums but the last few, reasons and escalations are kept apart from the rest."""

    def __init__(self, cfg: Vitals, slim: dict | None, latencies: dict[int, int], recent: dict[int, list[int]], sums: Callable[[int], float]):
        self.cfg, self.sums, self.latencies, self.recent = cfg, sums, latencies, recent
        # waiting: asks without a reply as [latest time since, [times of asks]], latest times falling
        self.slim = slim or {"name": None, "piece": -1, "day": None, "error": None, "number": 0, "open": None, "waiting": [], "asks": 0, "oldest": None, "texts": 0, "window": [], "peak": None, "peak_at": 0, "sum": 0.0}
        self.first, self.tail, self.lists = 0, [], [False, False]
        self.bigrams, self.grams = None, []  # of the window, made when a text comes
        self.new_sums: dict[int, float] = {}
        self.new_reasons: list[str] = []
        self.new_escalations: list[int] = []

    def line(self, r) -> None:
        s = self.slim
        if r.is_date:
            s["day"] = int(r.day)
        elif r.is_message and s["day"] is not None and not r.system:
            s["number"] += 1
            ts, special = s["day"] * DAY + int(r.minute) * MINUTE, bool(r.is_sticker or r.is_image)
            held = s["open"]
            if held and held["sender"] == r.sender and not special and not held["special"] and ts - held["ts"] <= self.cfg.merge_seconds * 1_000_000:
                held["text"] += " " + r.text
                return
            self.close()
            s["open"] = {"id": f"{s['name']}_{s['number']:05d}", "sender": r.sender, "staff": bool(r.staff), "ts": ts, "text": r.text, "special": special, "sticker": bool(r.is_sticker)}

    def close(self) -> None:
        """The open message is whole."""
        s, cfg, m = self.slim, self.cfg, self.slim["open"]
        if not m:
            return
        s["open"], ts = None, m["ts"]
        text = m["text"] if m["special"] else m["text"].strip()
        act, sentiment, escalates = tags(text, m["special"], cfg)
        since: list[int] = []
        while s["waiting"] and (s["waiting"][-1][0] is None or s["waiting"][-1][0] <= ts):
            asks = s["waiting"].pop()[1]
            since = asks + since if since else asks
        if since:
            s["waiting"].append([ts, since])
        if m["staff"]:
            for latest, asks in s["waiting"]:
                for asked in asks:
                    if latest - asked < cfg.i2_cap_days * DAY:
                        took = int(service_minutes(asked, ts, cfg))
                        self.latencies[took] = self.latencies.get(took, 0) + 1
            s["waiting"], s["asks"], s["oldest"] = [], 0, None
        elif act in ("question", "request"):
            s["waiting"].append([None, [ts]])
            s["asks"], s["oldest"] = s["asks"] + 1, ts if s["oldest"] is None else min(ts, s["oldest"])
        counts = self.recent.setdefault(ts, [0, 0, 0])
        counts[0] += 1
        if not m["staff"] and not m["sticker"]:
            counts[1] += 1
            counts[2] += sentiment < cfg.negative_below
        if escalates:
            self.new_reasons.append(f"升級詞觸發 (msg_id={m['id']}): {text[:30]}")
        if text and not m["sticker"]:
            if self.bigrams is None:
                self.bigrams, self.grams = Multiset(), [Multiset.of(t) for t in s["window"]]
                for found in self.grams:
                    self.bigrams.move(found, 1)
            s["window"], self.grams = [*s["window"], text], [*self.grams, Multiset.of(text)]
            self.bigrams.move(self.grams[-1], 1)
            while len(self.grams) > cfg.entropy_window:
                self.bigrams.move(self.grams.pop(0), -1)
                s["window"].pop(0)
            bits = self.bigrams.bits()
            s["sum"] += bits
            if s["peak"] is None or round(bits, 9) > s["peak"]:
                s["peak"], s["peak_at"] = round(bits, 9), s["texts"]
            if escalates:
                self.new_escalations.append(s["texts"])
            s["texts"] += 1
            self.new_sums[s["texts"]] = s["sum"]

    def score(self, now: int) -> dict:
        """The indicators at a time, the open message included."""
        g = copy.copy(self)
        g.bigrams, g.grams = copy.deepcopy(self.bigrams), list(self.grams)
        g.slim, g.latencies, g.recent = copy.deepcopy(self.slim), dict(self.latencies), {t: list(c) for t, c in self.recent.items()}
        g.new_sums, g.new_reasons, g.new_escalations = dict(self.new_sums), list(self.new_reasons), list(self.new_escalations)
        g.close()
        s, cfg = g.slim, g.cfg
        replies, place, p90 = sum(g.latencies.values()), 0, 0.0
        rank = min(replies * 9 // 10, replies - 1)
        for minutes in sorted(g.latencies):
            place += g.latencies[minutes]
            if place > rank:
                p90 = float(minutes)
                break
        late = [c for t, c in g.recent.items() if t >= now - cfg.i4_hours * 60 * MINUTE]
        said = sum(c[1] for c in late)
        n, half = s["texts"], s["texts"] // 2
        at = lambda k: g.new_sums[k] if k in g.new_sums else g.sums(k)
        drawn = n >= 2
        return {
            "group_id": s["name"], "error": s["error"], "i1_open_questions": s["asks"], "i1_oldest_age_min": service_minutes(s["oldest"], now, cfg) if s["asks"] else 0.0,
            "i2_p90_min": p90, "i2_replies": replies, "i4_neg_ratio": sum(c[2] for c in late) / said if said else 0.0, "i5_msg_count_24h": sum(c[0] for t, c in g.recent.items() if t >= now - cfg.i5_hours * 60 * MINUTE),
            "i6_mean_entropy": s["sum"] / n if drawn else 0.0, "i6_entropy_slope": (s["sum"] - at(half)) / (n - half) - at(half) / half if drawn else 0.0,
            "i6_peak_entropy_frac": s["peak_at"] / (n - 1) if drawn else 0.5, "i6_points": n if drawn else 0,
            "escalations": g.new_escalations, "reasons": g.new_reasons, "texts": n,
        }


OUT = "group_key string, group_id string, error string, i1_open_questions int, i1_oldest_age_min double, i2_p90_min double, i2_replies int, i4_neg_ratio double, i5_msg_count_24h int, i6_mean_entropy double, i6_entropy_slope double, i6_peak_entropy_frac double, i6_points int, i6_escalation_fracs array<double>, reasons array<string>, computed_at_us long"


class Scorer(StatefulProcessor):
    """now: the clock; refresh: minutes after which a group is scored again by a timer (None: only when lines come)."""

    def __init__(self, cfg: Vitals, now: Callable[[], datetime], refresh: int | None = None):
        self.cfg, self.now, self.refresh = cfg, now, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slim = handle.getValueState("slim", "json string")
        self.sums = handle.getMapState("sums", "block int", "json string")
        self.reasons = handle.getListState("reasons", "reason string")
        self.escalations = handle.getListState("escalations", "pos int")

    def _load(self) -> Group:
        kept = self.slim.get()
        slim = json.loads(kept[0]) if kept is not None else {}
        latencies, recent, tail = ({k: v for k, v in slim.pop("latencies", ())}, {t: c for t, c in slim.pop("recent", ())}, slim.pop("tail", []))
        lists = slim.pop("lists", [False, False])
        block = lambda i: json.loads(self.sums.getValue((i,))[0])
        # whole blocks of sums are kept apart, the rest with the value
        g = Group(self.cfg, slim or None, latencies, recent, lambda k: block((k - 1) // BLOCK)[(k - 1) % BLOCK] if k <= g.first else g.tail[k - 1 - g.first])
        g.tail, g.lists, g.first = tail, lists, g.slim["texts"] - len(tail)
        return g

    def _keep(self, g: Group, oldest: int) -> None:
        """One value for most groups: each call of the state store costs as much as some lines."""
        tail = g.tail + [g.new_sums[k] for k in sorted(g.new_sums)]
        while len(tail) >= BLOCK:
            self.sums.updateValue((g.first // BLOCK,), (json.dumps(tail[:BLOCK]),))
            tail, g.first = tail[BLOCK:], g.first + BLOCK
        for state, new in ((self.reasons, g.new_reasons), (self.escalations, g.new_escalations)):
            if new:
                state.appendList([(x,) for x in new])
        more = {"latencies": list(g.latencies.items()), "recent": [(t, c) for t, c in g.recent.items() if t >= oldest], "tail": tail, "lists": [g.lists[0] or bool(g.new_reasons), g.lists[1] or bool(g.new_escalations)]}
        self.slim.update((json.dumps(g.slim | more, ensure_ascii=False),))

    def _scored(self, key, g: Group, now: datetime) -> Row:
        us = int((now - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        row = g.score(us)
        places = [*((x[0] for x in self.escalations.get()) if g.lists[1] else ()), *row.pop("escalations")]
        said = [*((x[0] for x in self.reasons.get()) if g.lists[0] else ()), *row.pop("reasons")]
        n = row.pop("texts")
        return Row(group_key=key[0], **row, i6_escalation_fracs=[p / (n - 1) for p in places] if n > 1 else [], reasons=said, computed_at_us=us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        g, now = self._load(), self.now()
        s = g.slim
        for r in sorted(rows, key=lambda r: (r.piece, r.line_no)):
            if r.line_no == 0 and r.piece <= s["piece"] or r.line_no > 0 and r.piece < s["piece"]:
                s["error"] = s["error"] or "piece out of order"
            if s["name"] is None:
                s["name"] = r.name
            s["piece"] = int(r.piece)
            if not r.valid:
                s["error"] = s["error"] or "not UTF-8"
            elif r.spoiled and (r.is_date or s["day"] is not None):
                s["error"] = s["error"] or "impossible date or time"
            elif not s["error"]:
                g.line(r)
        oldest = int((now - datetime(1970, 1, 1)).total_seconds() * 1_000_000) - max(self.cfg.i4_hours, self.cfg.i5_hours) * 60 * MINUTE
        yield self._scored(key, g, now)
        self._keep(g, oldest)
        if self.refresh:
            self._again(timerValues.getCurrentProcessingTimeInMs())

    def _again(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(ms + self.refresh * 60_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._scored(key, self._load(), self.now())
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.refresh * 60_000)

    def close(self) -> None:
        pass


def piece_lines(pieces: DataFrame) -> DataFrame:
    """(group_key, piece, valid, line_no, raw): a row per line of (path, content)."""
    name = F.try_url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    part = lambda i: F.regexp_extract(name, r"^(.*)@(\d+)\.[^.]*$", i)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    rows = pieces.select(part(1).alias("group_key"), part(2).cast("int").alias("piece"), valid.alias("valid"), F.posexplode_outer(F.when(valid, lines(text))).alias("line_no", "raw"))
    return rows.withColumn("line_no", F.coalesce("line_no", F.lit(0)))


def score(rows: DataFrame, staff: DataFrame, now: Callable[[], datetime], cfg: Vitals = Vitals(), refresh: int | None = None, scorer: type = Scorer) -> DataFrame:
    """Metrics of the groups that grow, from a stream of (group_key, piece, valid, line_no, raw); the session's state store has to be RocksDB
    (spark.sql.streaming.stateStore.providerClass = PROVIDER)."""
    rows = exports.line_fields(rows)
    head = F.when(F.col("raw").startswith(exports.TAG), exports.strip(F.replace("raw", F.lit(exports.TAG), F.lit(""))))
    sticker, image = F.col("body").isin(*cfg.sticker), F.col("body").isin(*cfg.image)
    rows = rows.join(staff.select(F.col("sender").alias("_staff")), F.col("sender") == F.col("_staff"), "left")
    events = rows.select("group_key", "piece", "line_no", "valid", F.coalesce(head, "group_key").alias("name"), "is_date", "is_message", F.coalesce(F.unix_date(F.col("day").cast("date")), F.lit(0)).alias("day"), F.coalesce("minute", F.lit(0)).alias("minute"),
        ((F.col("is_date") & F.col("day").isNull()) | (F.col("is_message") & F.col("minute").isNull())).alias("spoiled"), "sender", F.col("sender").isin(*cfg.system_senders).alias("system"), F.col("_staff").isNotNull().alias("staff"),
        F.when(sticker | image, "").otherwise(F.col("body")).alias("text"), sticker.alias("is_sticker"), image.alias("is_image"))
    return finished(events.groupBy("group_key").transformWithState(scorer(cfg, now, refresh), OUT, "Update", "ProcessingTime" if refresh else "None"), cfg)


def finished(scored: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    """Scored groups with severities, tripwire and composite, as group_metrics has them."""
    c = F.col
    aged = F.concat(F.lit("未回應提問超過8業務小時 ("), F.bround("i1_oldest_age_min").cast("long").cast("string"), F.lit("分鐘)"))
    held: Callable[[Column, Column], Column] = lambda when, value: F.when(when, value).otherwise(F.lit(0.0))
    out = scored.withColumns({
        "i1_severity": held(c("i1_open_questions") > 0, age_to_severity(c("i1_oldest_age_min"), cfg.i1_warn, cfg.i1_crit)), "i2_severity": held(c("i2_replies") > 0, age_to_severity(c("i2_p90_min"), cfg.i2_warn, cfg.i2_crit)),
        "i3_severity": F.lit(0.0), "i4_severity": ratio_severity(c("i4_neg_ratio")), "tripwire_reasons": F.when((c("i1_open_questions") > 0) & (c("i1_oldest_age_min") >= cfg.tripwire_age), F.array_append("reasons", aged)).otherwise(c("reasons")),
    })
    out = out.withColumn("tripwire", F.size("tripwire_reasons") > 0)
    return out.withColumns({"composite": composite(cfg), "computed_at": F.timestamp_micros("computed_at_us")}).drop("reasons", "computed_at_us")


def watch(spark: SparkSession, directory: str, staff_path: str, now: Callable[[], datetime], sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: Vitals = Vitals(), once: bool = False, refresh: int | None = None) -> StreamingQuery:
    """Calls sink(metrics of the groups that grew, batch number) for every micro-batch of pieces in directory.  An empty file brings no line, so a group is
    known from its first line on."""
    pieces = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*@*.txt").load(directory)
    scored = score(piece_lines(pieces), exports.load_staff(spark, staff_path), now, cfg, refresh)
    writer = scored.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(lines: DataFrame, staff: DataFrame, now: datetime, pieces: int, folder: str, cfg: Vitals = Vitals()) -> DataFrame:
    """The metrics after all of (group_key, piece, line_no, raw) has come in, one piece of every group after the other; folder: for the stream's files."""
    spark, name = lines.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        for p in range(pieces):
            lines.filter(F.col("piece") == p).write.mode("append").parquet(f"{folder}/lines")
            stream = score(spark.readStream.schema(lines.schema).parquet(f"{folder}/lines").withColumn("valid", F.lit(True)), staff, lambda: now, cfg)
            writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/scores"))
            writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    scores = spark.read.parquet(f"{folder}/scores")
    return scores.groupBy("group_key").agg(F.max_by(F.struct(*(c for c in scores.columns if c != "group_key")), "batch").alias("x")).select("group_key", "x.*")
