"""Queries of the chat operators on the driver tables, each with its SQL.  Where it can, the SQL takes another way."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import held
from .config import ACK, CHIT_CHAT, COMPLAINT, ESCALATION, IMAGE, NEGATIVE, POSITIVE, QUESTION, REQUEST, STICKER, Vitals
from .functions import labels
from .functions.rules import enrich
from .functions.service_time import age_to_severity, in_service, service_minutes
from .functions.text import lines
from .operators import entropy, indicators, issues, lanes, ledger
from .operators.merge import merge_fragments
from .operators.replies import is_ask, with_replies, within_cap
from .plans import analysis, cli, report
from .sources import adapters, exports
from .streaming import groups

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _chat_now():
    return analysis.clock(datetime.fromisoformat(adapters.CHAT_NOW))


def _event_now():
    return analysis.clock(datetime.fromisoformat(adapters.EVENT_NOW))


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# ---- SQL building blocks -------------------------------------------------------------------------------------------


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(column: str, patterns) -> str:
    return f"regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


def _hits(words) -> str:
    return " + ".join(f"contains(text, '{w}')::INT" for w in words)


_GAP = "CASE (conv_id * 31 + turn * 17) % 8 " + " ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(adapters.GAPS)) + " END"
_PHRASE = "CASE (conv_id * 7 + turn * 3) % 16 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(adapters.PHRASES)) + " END"
_NOW = f"TIMESTAMP '{adapters.CHAT_NOW}'"
_EVENT_NOW = f"TIMESTAMP '{adapters.EVENT_NOW}'"
_CHAT = f"""turns AS (SELECT conv_id, turn, role, text, sum({_GAP}) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations),
parts AS (SELECT conv_id, turn, role, gap, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM turns WHERE role IN ('user', 'assistant')),
bodies AS (SELECT *, trim(CASE WHEN line_no = 0 THEN coalesce({_PHRASE}, line) ELSE line END) AS body FROM parts),
m AS (SELECT conv_id AS g, turn * 1000 + line_no AS seq, printf('%d_%05d', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_no)) AS msg_id,
 (CASE role WHEN 'assistant' THEN 'staff' ELSE 'customer' END) || (conv_id % 3) AS sender, CASE role WHEN 'assistant' THEN 'staff' ELSE 'customer' END AS role,
 TIMESTAMP '2025-09-01 08:00:00' + to_minutes(((conv_id % 5) * 1440 + gap + line_no)::INT) AS ts,
 CASE WHEN body IN ({_in(STICKER + IMAGE)}) THEN '' ELSE body END AS text, body IN ({_in(STICKER)}) AS is_sticker, body IN ({_in(IMAGE)}) AS is_image FROM bodies WHERE body <> '')"""
_MERGED = f"""{_CHAT},
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS rn FROM m),
walk AS (SELECT g, rn, rn AS first_rn, ts AS first_ts, sender, is_sticker OR is_image AS special FROM n WHERE rn = 1
 UNION ALL
 SELECT n.g, n.rn, CASE WHEN n.sender = w.sender AND NOT w.special AND NOT (n.is_sticker OR n.is_image) AND epoch_us(n.ts) - epoch_us(w.first_ts) <= 60000000 THEN w.first_rn ELSE n.rn END,
 CASE WHEN n.sender = w.sender AND NOT w.special AND NOT (n.is_sticker OR n.is_image) AND epoch_us(n.ts) - epoch_us(w.first_ts) <= 60000000 THEN w.first_ts ELSE n.ts END, n.sender, n.is_sticker OR n.is_image
 FROM walk w JOIN n ON n.g = w.g AND n.rn = w.rn + 1),
mm AS (SELECT a.g, a.seq, a.msg_id, a.sender, a.role, a.ts, trim(string_agg(n.text, ' ' ORDER BY n.rn)) AS text, a.is_sticker, a.is_image
 FROM walk w JOIN n ON n.g = w.g AND n.rn = w.rn JOIN n a ON a.g = w.g AND a.rn = w.first_rn GROUP BY ALL)"""


def _enriched(source: str) -> str:
    act = f"""CASE WHEN is_sticker OR is_image THEN 'ack' WHEN trim(text) = '' THEN 'chit_chat' WHEN {_any('trim(text)', ACK)} THEN 'ack' WHEN {_any('trim(text)', QUESTION)} THEN 'question'
 WHEN {_any('trim(text)', REQUEST)} THEN 'request' WHEN {_any('trim(text)', COMPLAINT)} THEN 'report' WHEN {_any('trim(text)', CHIT_CHAT)} THEN 'chit_chat' ELSE 'answer' END"""
    pos, neg = f"({_hits(POSITIVE)})", f"({_hits(NEGATIVE)})"
    return f"""e AS (SELECT *, {act} AS act, CASE WHEN {pos} + {neg} = 0 THEN 0.0::DOUBLE ELSE ({pos} - {neg})::DOUBLE / ({pos} + {neg}) END AS sentiment, {' OR '.join(f"contains(text, '{w}')" for w in ESCALATION)} AS esc FROM {source})"""


_CROWD = "crowd AS (SELECT * REPLACE (CASE WHEN g % 10 < 9 THEN 0 ELSE g END AS g, g * 10000000 + seq AS seq) FROM m)"
_E = f"WITH RECURSIVE {_MERGED}, {_enriched('mm')}"
_ASK = "role = 'customer' AND act IN ('question', 'request')"
_EVENTS = """WITH e AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'purchase' THEN 'staff' ELSE 'customer' END AS role, ts,
 CASE event_type WHEN 'error' THEN 'question' ELSE 'answer' END AS act FROM events)"""


def _minutes(start: str, end: str) -> str:
    """Counted one by one."""
    return f"CASE WHEN {end} > {start} THEN len(list_filter(range({start}, {end}, INTERVAL 1 MINUTE), lambda x: isodow(x) <= 5 AND hour(x) >= 9 AND hour(x) < 18)) ELSE 0 END::DOUBLE"


def _severity(x: str, warn: float, crit: float) -> str:
    return f"CASE WHEN {x} < {warn} THEN 0.0 WHEN {x} >= {crit} THEN 1.0 ELSE ({x} - {warn}) / {crit - warn} END"


def _i1(now: str) -> str:
    return f"""one AS (SELECT g, count(*) AS i1_open_questions, max(age) AS i1_oldest_age_min, max({_severity('age', 30.0, 360.0)}) AS i1_severity FROM
 (SELECT g, {_minutes('ts', now)} AS age FROM e a WHERE {_ASK} AND NOT EXISTS (SELECT 1 FROM e b WHERE b.g = a.g AND b.seq > a.seq AND b.role = 'staff')) GROUP BY g)"""


_PAIRS = f"""firsts AS (SELECT a.g, a.seq, a.ts, a.text, min(b.seq) AS rseq FROM e a JOIN e b ON b.g = a.g AND b.seq > a.seq AND b.role = 'staff' WHERE a.role = 'customer' AND a.act IN ('question', 'request') GROUP BY ALL),
pairs AS (SELECT f.g, f.seq, f.ts, f.text, r.seq AS rseq, r.ts AS rts, r.text AS rtext FROM firsts f JOIN e r ON r.g = f.g AND r.seq = f.rseq),
capped AS (SELECT p.*, {_minutes('p.ts', 'p.rts')} AS lat FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.g = p.g AND x.seq > p.seq AND x.seq <= p.rseq AND epoch_us(x.ts) - epoch_us(p.ts) >= 4 * 86400000000))"""
_PAIRS_EVENTS = _PAIRS.replace("a.ts, a.text,", "a.ts,").replace("f.ts, f.text,", "f.ts,").replace(", r.text AS rtext", "")
_I2 = """two AS (SELECT g, lat AS i2_p90_min, n AS replies FROM (SELECT g, lat, row_number() OVER (PARTITION BY g ORDER BY lat, seq) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM capped) WHERE k = least(n * 9 // 10, n - 1))"""
_SERIES = """t AS (SELECT g, ts, text, esc, row_number() OVER (PARTITION BY g ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM e WHERE text <> '' AND NOT is_sticker),
grams AS (SELECT g, pos, substring(text, k::INT, 2) AS gram FROM (SELECT g, pos, text, unnest(range(1, length(text))) AS k FROM t)),
wins AS (SELECT a.g, a.pos, b.gram, count(*) AS c FROM t a JOIN grams b ON b.g = a.g AND b.pos BETWEEN a.pos - 4 AND a.pos WHERE a.n >= 2 GROUP BY ALL),
sums AS (SELECT *, sum(c) OVER (PARTITION BY g, pos) AS s FROM wins),
h AS (SELECT g, pos, greatest(0.0, -sum((c / s) * log2(c / s))) AS entropy FROM sums GROUP BY g, pos),
series AS (SELECT t.g, t.pos, t.ts, t.n, coalesce(h.entropy, 0.0) AS entropy FROM t LEFT JOIN h ON h.g = t.g AND h.pos = t.pos WHERE t.n >= 2),
six AS (SELECT g, avg(entropy) AS mean, avg(entropy) FILTER (pos >= n // 2) - avg(entropy) FILTER (pos < n // 2) AS slope, arg_max(pos, (round(entropy, 9), -pos)) / (max(n) - 1) AS peak, max(n) AS n FROM series GROUP BY g)"""
_METRICS = f"""{_E}, {_i1(_NOW)}, {_PAIRS}, {_I2}, {_SERIES},
four AS (SELECT g, avg((sentiment < -0.1)::INT) AS ratio FROM e WHERE role = 'customer' AND ts >= {_NOW} - INTERVAL 72 HOUR AND NOT is_sticker GROUP BY g),
five AS (SELECT g, count(*) FILTER (ts >= {_NOW} - INTERVAL 24 HOUR) AS n, bool_or(esc) AS esc FROM e GROUP BY g),
x AS (SELECT five.g, five.n AS i5, coalesce(i1_severity, 0.0) AS s1, coalesce(i1_open_questions, 0) AS open1, coalesce(i1_oldest_age_min, 0.0) AS age1, coalesce(i2_p90_min, 0.0) AS p90, {_severity('coalesce(i2_p90_min, 0.0)', 120.0, 480.0)} AS s2,
 coalesce(ratio, 0.0) AS r4, least(1.0, greatest(0.0, (coalesce(ratio, 0.0) - 0.1) / 0.5)) AS s4, five.esc OR coalesce(i1_oldest_age_min, 0.0) >= 480 AS trip, coalesce(mean, 0.0) AS mean, coalesce(slope, 0.0) AS slope, coalesce(peak, 0.5) AS peak
 FROM five LEFT JOIN one ON one.g = five.g LEFT JOIN two ON two.g = five.g LEFT JOIN four ON four.g = five.g LEFT JOIN six ON six.g = five.g),
metrics AS (SELECT *, CASE WHEN trip THEN greatest(0.35 * s1 + 0.2 * s2 + 0.15 * 0.0 + 0.3 * s4, 0.95) ELSE 0.35 * s1 + 0.2 * s2 + 0.15 * 0.0 + 0.3 * s4 END::DOUBLE AS score FROM x)"""


# ---- adapters as Spark frames --------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.chat_messages(spark, sf_dir)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.prepare(_raw(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _merged(spark, sf_dir)
    return analysis.group_metrics(messages, _chat_now(), messages.select("group_key", "group_id").distinct())


def _g():
    return F.col("group_key").alias("g")


#: Few rows a lane, so that the giant group has many lanes on any table.
_LANES = Vitals(lane_rows=100)


def _crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.prepare(adapters.crowd_messages(spark, sf_dir), _LANES)


def _crowded(sql: str) -> str:
    """SQL over the giant group in place of the conversations."""
    return sql.replace("n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS rn FROM m)", f"{_CROWD}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS rn FROM crowd)")


# ---- queries -------------------------------------------------------------------------------------------------------


@query(f"WITH {_CHAT} SELECT 'group ' || g AS group_id, row_number() OVER (PARTITION BY g ORDER BY seq) AS msg_no, sender, role, ts, text, is_sticker, is_image FROM m")
def parse_exports(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    staff = raw.filter("role = 'staff'").select("sender").distinct()
    messages, _ = exports.parse(adapters.export_files(raw), staff)
    return messages.select("group_id", F.substring_index("msg_id", "_", -1).cast("long").alias("msg_no"), "sender", "role", "ts", "text", "is_sticker", "is_image")


@query(f"WITH {_CHAT}, {_CROWD} SELECT 'group ' || g AS group_id, row_number() OVER (PARTITION BY g ORDER BY seq) AS msg_no, sender, role, ts, text, is_sticker, is_image FROM crowd")
def parse_exports_crowd(spark, sf_dir):
    """One file has nine tenths of all lines; it is read in lanes."""
    raw = adapters.crowd_messages(spark, sf_dir)
    staff = raw.filter("role = 'staff'").select("sender").distinct()
    messages, _ = exports.parse(adapters.export_files(raw), staff, _LANES, long_files=True)
    return messages.select("group_id", F.substring_index("msg_id", "_", -1).cast("long").alias("msg_no"), "sender", "role", "ts", "text", "is_sticker", "is_image")


@query(f"WITH {_CHAT} SELECT 'group ' || g AS group_id, NULL::VARCHAR AS error, count(*) AS n FROM m GROUP BY g")
def parse_status(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    messages, status = exports.parse(adapters.export_files(raw), raw.select("sender").distinct())
    return status.join(messages.groupBy("group_key").agg(F.count("*").alias("n")), "group_key", "left").select("group_id", F.col("error").cast("string").alias("error"), "n")


@query(f"WITH {_CHAT} SELECT m.g, m.seq, CASE WHEN s.sender IS NULL THEN 'customer' ELSE 'staff' END AS role FROM m LEFT JOIN (SELECT DISTINCT sender FROM m WHERE role = 'staff') s ON s.sender = m.sender")
def staff_membership(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    staff = raw.filter("role = 'staff'").select(F.col("sender").alias("staff")).distinct()
    return raw.join(staff, F.col("sender") == F.col("staff"), "left").select(_g(), "seq", F.when(F.col("staff").isNull(), "customer").otherwise("staff").alias("role"))


@query(f"WITH RECURSIVE {_MERGED} SELECT g, seq, msg_id, sender, role, ts, text, is_sticker, is_image FROM mm")
def merge_messages(spark, sf_dir):
    return merge_fragments(_raw(spark, sf_dir)).select(_g(), "seq", "msg_id", "sender", "role", "ts", "text", "is_sticker", "is_image")


@query(_crowded(f"WITH RECURSIVE {_MERGED} SELECT g, seq, sender, role, ts, text, is_sticker, is_image FROM mm"))
def merge_messages_crowd(spark, sf_dir):
    """One group has nine tenths of all rows; it is merged in lanes."""
    found = merge_fragments(lanes.assign(adapters.crowd_messages(spark, sf_dir), _LANES.lane_rows), _LANES)
    return found.select(_g(), "seq", "sender", "role", "ts", "text", "is_sticker", "is_image")


@query(f"WITH {_CHAT}, {_enriched('m')} SELECT g, seq, act AS dialogue_act, round(sentiment, 6) AS sentiment, esc AS is_escalation_marker FROM e")
def enrich_messages(spark, sf_dir):
    return enrich(_raw(spark, sf_dir)).select(_g(), "seq", "dialogue_act", r6("sentiment").alias("sentiment"), "is_escalation_marker")


@query(f"""WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 18 AS in_service, {_minutes('before', 'ts')} AS minutes, round({_severity(_minutes('before', 'ts'), 30.0, 360.0)}, 6)::DOUBLE AS severity FROM p WHERE before IS NOT NULL""")
def service_time(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    e = e.withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("before is not null").withColumn("minutes", service_minutes(F.col("before"), F.col("ts")))
    return e.select("event_id", in_service(F.col("ts")).alias("in_service"), "minutes", r6(age_to_severity(F.col("minutes"), 30.0, 360.0)).alias("severity"))


@query(f"{_E}, {_i1(_NOW)} SELECT g, i1_open_questions, i1_oldest_age_min, round(i1_severity, 6)::DOUBLE AS i1_severity FROM one")
def i1_unanswered(spark, sf_dir):
    return indicators.i1(_merged(spark, sf_dir), _chat_now()).select(_g(), F.col("i1_open_questions").cast("long").alias("i1_open_questions"), "i1_oldest_age_min", r6("i1_severity").alias("i1_severity"))


@query(f"{_EVENTS}, {_i1(_EVENT_NOW)} SELECT g, i1_open_questions, i1_oldest_age_min, round(i1_severity, 6)::DOUBLE AS i1_severity FROM one")
def i1_unanswered_events(spark, sf_dir):
    return indicators.i1(adapters.event_messages(spark, sf_dir), _event_now()).select(_g(), F.col("i1_open_questions").cast("long").alias("i1_open_questions"), "i1_oldest_age_min", r6("i1_severity").alias("i1_severity"))


@query(f"{_E}, {_PAIRS} SELECT g, seq, rseq AS reply_seq, rts AS reply_ts, lat AS latency_min FROM capped")
def i2_first_reply(spark, sf_dir):
    return indicators.latencies(_merged(spark, sf_dir)).select(_g(), "seq", "reply_seq", "reply_ts", "latency_min")


@query(_crowded(f"{_E}, {_PAIRS} SELECT g, seq, rseq AS reply_seq, rts AS reply_ts, lat AS latency_min FROM capped"))
def i2_first_reply_crowd(spark, sf_dir):
    return indicators.latencies(_crowd(spark, sf_dir), _LANES).select(_g(), "seq", "reply_seq", "reply_ts", "latency_min")


@query(f"{_E}, {_PAIRS}, {_I2} SELECT g, i2_p90_min, replies, round({_severity('i2_p90_min', 120.0, 480.0)}, 6)::DOUBLE AS i2_severity FROM two")
def i2_latency_p90(spark, sf_dir):
    return indicators.i2(_merged(spark, sf_dir)).select(_g(), "i2_p90_min", F.col("i2_replies").cast("long").alias("replies"), r6("i2_severity").alias("i2_severity"))


@query(f"{_EVENTS}, {_PAIRS_EVENTS}, {_I2} SELECT g, i2_p90_min, replies, round({_severity('i2_p90_min', 120.0, 480.0)}, 6)::DOUBLE AS i2_severity FROM two")
def i2_latency_p90_events(spark, sf_dir):
    return indicators.i2(adapters.event_messages(spark, sf_dir)).select(_g(), "i2_p90_min", F.col("i2_replies").cast("long").alias("replies"), r6("i2_severity").alias("i2_severity"))


@query(f"{_E}, {_PAIRS} SELECT g, ts, substring(text, 1, 80) AS text, rts AS reply_ts, substring(rtext, 1, 80) AS reply_text, floor((epoch_us(rts) - epoch_us(ts)) / 60000000)::BIGINT AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS k FROM pairs) WHERE k = 1")
def latency_example(spark, sf_dir):
    return indicators.latency_example(_merged(spark, sf_dir)).select(_g(), "ts", "text", "reply_ts", "reply_text", "minutes")


@query(f"{_E} SELECT g, k AS ord, ts, substring(text, 1, 80) AS text FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS k FROM e WHERE role = 'customer' AND sentiment < -0.1 AND NOT is_sticker) WHERE k <= 3")
def negative_examples(spark, sf_dir):
    return indicators.negative_examples(_merged(spark, sf_dir)).select(_g(), F.col("ord").cast("long").alias("ord"), "ts", "text")


@query(f"{_E} SELECT g, round(avg((sentiment < -0.1)::INT), 6) AS i4_neg_ratio, round(least(1.0, greatest(0.0, (avg((sentiment < -0.1)::INT) - 0.1) / 0.5)), 6) AS i4_severity FROM e WHERE role = 'customer' AND ts >= {_NOW} - INTERVAL 72 HOUR AND NOT is_sticker GROUP BY g")
def i4_negative_ratio(spark, sf_dir):
    return indicators.i4(_merged(spark, sf_dir), _chat_now()).select(_g(), r6("i4_neg_ratio").alias("i4_neg_ratio"), r6("i4_severity").alias("i4_severity"))


@query(f"{_E} SELECT g, count(*) FILTER (ts >= {_NOW} - INTERVAL 24 HOUR) AS i5_msg_count_24h FROM e GROUP BY g")
def i5_volume(spark, sf_dir):
    return indicators.i5(_merged(spark, sf_dir), _chat_now()).select(_g(), F.col("i5_msg_count_24h").cast("long").alias("i5_msg_count_24h"))


@query(f"""{_E}, {_i1(_NOW)}, r AS (SELECT g, seq, '升級詞觸發 (msg_id=' || msg_id || '): ' || substring(text, 1, 30) AS reason FROM e WHERE esc
 UNION ALL SELECT g, 9223372036854775807, '未回應提問超過8業務小時 (' || i1_oldest_age_min::BIGINT || '分鐘)' FROM one WHERE i1_oldest_age_min >= 480) SELECT g, row_number() OVER (PARTITION BY g ORDER BY seq) AS ord, reason FROM r""")
def tripwire_reasons(spark, sf_dir):
    messages = _merged(spark, sf_dir)
    found = analysis.tripwire_reasons(messages, indicators.i1(messages, _chat_now()))
    return found.select(_g(), F.posexplode("tripwire_reasons").alias("ord", "reason")).select("g", (F.col("ord") + 1).cast("long").alias("ord"), "reason")


@query("SELECT gram AS bigram, count(*) AS n FROM (SELECT substring(text, k::INT, 2) AS gram FROM (SELECT text, unnest(range(1, length(text))) AS k FROM documents WHERE text IS NOT NULL)) GROUP BY gram")
def bigram_counts(spark, sf_dir):
    return entropy.bigram_counts(analysis.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))


@query("""WITH c AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, substring(text, k::INT, 2) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS k FROM documents WHERE text IS NOT NULL)) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) SELECT doc_id, round(greatest(0.0, -sum((n / t) * log2(n / t))), 6) + 0.0 AS entropy FROM s GROUP BY doc_id""")
def bigram_entropy(spark, sf_dir):
    texts = analysis.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return entropy.text_entropy(texts, "doc_id").select("doc_id", r6("entropy").alias("entropy"))


@query(f"{_E}, {_SERIES} SELECT g, pos, ts, round(entropy, 6) + 0.0 AS entropy FROM series")
def entropy_series(spark, sf_dir):
    return entropy.entropy_series(_merged(spark, sf_dir)).select(_g(), F.col("pos").cast("long").alias("pos"), "ts", r6("entropy").alias("entropy"))


@query(f"{_E}, {_SERIES} SELECT g, round(mean, 6) + 0.0 AS mean_entropy, round(slope, 6) + 0.0 AS slope, round(peak, 6) + 0.0 AS peak_frac, n AS points FROM six")
def entropy_stats(spark, sf_dir):
    found = entropy.i6(entropy.entropy_series(_merged(spark, sf_dir)))
    return found.select(_g(), r6("i6_mean_entropy").alias("mean_entropy"), r6("i6_entropy_slope").alias("slope"), r6("i6_peak_entropy_frac").alias("peak_frac"), F.col("i6_points").cast("long").alias("points"))


@query(f"{_E}, {_SERIES} SELECT g, pos, round(pos / (n - 1), 6) + 0.0 AS frac FROM t WHERE esc AND n > 1")
def escalation_fracs(spark, sf_dir):
    return entropy.escalation_fracs(_merged(spark, sf_dir)).select(_g(), F.col("pos").cast("long").alias("pos"), r6("frac").alias("frac"))


@query(f"{_E}, {_SERIES} SELECT g, pos, round(pos / (n - 1), 6) + 0.0 AS x, round((entropy - min(entropy) OVER (PARTITION BY g)) / greatest(max(entropy) OVER (PARTITION BY g) - min(entropy) OVER (PARTITION BY g), 0.5), 5) + 0.0 AS y FROM series")
def chart_points(spark, sf_dir):
    return entropy.chart_points(entropy.entropy_series(_merged(spark, sf_dir))).select(_g(), F.col("pos").cast("long").alias("pos"), r6("x").alias("x"), (F.round("y", 5) + 0.0).alias("y"))


_METRICS_SQL = f"""{_METRICS} SELECT g, round(s1, 6)::DOUBLE AS i1_severity, open1 AS i1_open_questions, age1 AS i1_oldest_age_min, round(s2, 6)::DOUBLE AS i2_severity, p90 AS i2_p90_min, round(r4, 6)::DOUBLE AS i4_neg_ratio, round(s4, 6)::DOUBLE AS i4_severity, i5 AS i5_msg_count_24h,
 trip AS tripwire, round(mean, 6) + 0.0 AS i6_mean_entropy, round(slope, 6) + 0.0 AS i6_entropy_slope, round(peak, 6) + 0.0 AS i6_peak_entropy_frac, round(score, 6)::DOUBLE AS composite FROM metrics"""


def _metric_columns(metrics: DataFrame) -> DataFrame:
    double = ("i1_severity", "i2_severity", "i4_neg_ratio", "i4_severity", "i6_mean_entropy", "i6_entropy_slope", "i6_peak_entropy_frac", "composite")
    long = ("i1_open_questions", "i5_msg_count_24h")
    return metrics.select(_g(), "tripwire", "i1_oldest_age_min", "i2_p90_min", *(r6(c).alias(c) for c in double), *(F.col(c).cast("long").alias(c) for c in long))


@query(_METRICS_SQL)
def compute_metrics(spark, sf_dir):
    return _metric_columns(_metrics(spark, sf_dir))


@query(_METRICS_SQL)
def compute_metrics_streamed(spark, sf_dir):
    """The conversations as exports that come in three pieces, by a stream with state for each group."""
    raw = adapters.chat_messages(spark, sf_dir)
    rows = adapters.export_files(raw).select(F.replace("source_file", F.lit(".txt"), F.lit("")).alias("group_key"), lines(F.col("content").cast("string")).alias("lines"))
    rows = rows.select("group_key", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "raw"))
    rows = held.once(rows.select("group_key", F.floor(F.col("line_no") * 3 / F.col("n")).cast("int").alias("piece"), "line_no", "raw"))
    staff = held.once(raw.filter("role = 'staff'").select("sender").distinct())
    found = groups.replay(rows, staff, datetime.fromisoformat(adapters.CHAT_NOW), 3, held.folder(spark))
    return _metric_columns(found.withColumn("group_key", F.col("group_key").cast("long")))


@query(_crowded(_METRICS_SQL))
def compute_metrics_crowd(spark, sf_dir):
    """One group has nine tenths of all rows; every indicator of it is computed in lanes."""
    messages = _crowd(spark, sf_dir)
    return _metric_columns(analysis.group_metrics(messages, _chat_now(), messages.select("group_key", "group_id").distinct(), _LANES))


@query(f"{_METRICS} SELECT row_number() OVER (ORDER BY trip DESC, score DESC, g) AS rank, g, round(score, 6)::DOUBLE AS composite, CASE WHEN trip THEN '紅旗' WHEN score >= 0.15 THEN '關注' ELSE '正常' END AS status FROM metrics")
def rank_groups(spark, sf_dir):
    out = analysis.ranked(_metrics(spark, sf_dir))
    return out.select(F.col("rank").cast("long").alias("rank"), _g(), r6("composite").alias("composite"), labels.status(F.col("tripwire"), F.col("composite")).alias("status"))


@query(f"""{_METRICS} SELECT g, CASE WHEN r4 >= 0.5 THEN '情緒極度異常' WHEN r4 >= 0.3 THEN '情緒明顯負面' WHEN r4 >= 0.1 THEN '情緒略顯不穩' ELSE '正常' END AS mood,
 CASE WHEN slope > 0.5 THEN '↑ 上升（對話趨複雜）' WHEN slope > 0.1 THEN '↗ 緩升' WHEN slope >= -0.1 THEN '→ 穩定' ELSE '↘ 收斂（對話趨專一）' END AS slope_label,
 CASE WHEN score >= 0.7 THEN 'red' WHEN score >= 0.35 THEN 'amber' ELSE 'green' END AS color, trunc(peak * 100)::BIGINT AS peak_pct,
 coalesce(nullif(concat_ws('、', CASE WHEN s2 >= 0.5 THEN 'I2' END, CASE WHEN s1 >= 0.3 THEN 'I1' END, CASE WHEN s4 >= 0.3 THEN 'I4' END), ''), 'composite') AS follow_up FROM metrics""")
def group_labels(spark, sf_dir):
    out = report.labelled(_metrics(spark, sf_dir))
    return out.select(_g(), "mood", "slope_label", "color", F.col("peak_pct").cast("long").alias("peak_pct"), "follow_up")


@query(f"{_METRICS} SELECT count(*) AS total, count(*) FILTER (trip) AS red, count(*) FILTER (NOT trip AND score >= 0.15) AS watch, count(*) FILTER (NOT trip AND score < 0.15) AS ok FROM metrics")
def overview_counts(spark, sf_dir):
    return analysis.overview(_metrics(spark, sf_dir))


_RANKED = f"{_METRICS}, o AS (SELECT *, row_number() OVER (ORDER BY trip DESC, score DESC, g) AS rank FROM metrics)"


@query(f"{_RANKED} SELECT CASE WHEN trip THEN 'red' ELSE 'ok' END AS kind, rank, g::VARCHAR AS name FROM o WHERE trip OR score < 0.15")
def overview_names(spark, sf_dir):
    return analysis.overview_names(analysis.ranked(_metrics(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_RANKED}, reasons AS (SELECT g, seq, '升級詞觸發 (msg_id=' || msg_id || '): ' || substring(text, 1, 30) AS reason FROM e WHERE esc
 UNION ALL SELECT g, 9223372036854775807, '未回應提問超過8業務小時 (' || i1_oldest_age_min::BIGINT || '分鐘)' FROM one WHERE i1_oldest_age_min >= 480),
l AS (SELECT rank, 0 AS ord, 0 AS sub, printf(chr(10) || '#%d  %s  %s', rank, g::VARCHAR, CASE WHEN trip THEN '🚨 [TRIPWIRE]' ELSE '' END) AS line FROM o
 UNION ALL SELECT rank, 1, 0, printf('    綜合分數: %.3f', score) FROM o
 UNION ALL SELECT rank, 2, 0, printf('    I1 未回應提問: severity=%.2f  開放題數=%d  最老=%.0f分', s1::DOUBLE, open1, age1) FROM o
 UNION ALL SELECT rank, 3, 0, printf('    I2 回應延遲P90: severity=%.2f  P90=%.0f分', s2::DOUBLE, p90) FROM o
 UNION ALL SELECT rank, 6, 0, printf('    I4 客戶負面情緒: severity=%.2f  負面比=%.1f%%  [%s]', s4::DOUBLE, r4 * 100, CASE WHEN r4 >= 0.5 THEN '⚠️ 情緒極度異常' WHEN r4 >= 0.3 THEN '⚠️ 情緒明顯負面' WHEN r4 >= 0.1 THEN '⚠️ 情緒略顯不穩' ELSE '正常' END) FROM o
 UNION ALL SELECT rank, 7, 0, printf('    I5 近24h訊息量: %d', i5) FROM o
 UNION ALL SELECT rank, 8, 0, printf('    I6 語義熵: mean=%.2fbits  slope=%+.2f  峰值@對話%d%%  [%s]', o.mean, o.slope, trunc(o.peak * 100)::BIGINT,
  CASE WHEN o.slope > 0.5 THEN '↑ 上升（對話趨複雜）' WHEN o.slope > 0.1 THEN '↗ 緩升' WHEN o.slope >= -0.1 THEN '→ 穩定' ELSE '↘ 收斂（對話趨專一）' END) FROM o SEMI JOIN six USING (g)
 UNION ALL SELECT rank, 9, row_number() OVER (PARTITION BY g ORDER BY seq) - 1, '    ⚠️  ' || reason FROM reasons JOIN o USING (g))
SELECT rank, ord::BIGINT AS ord, sub::BIGINT AS sub, line FROM l""")
def report_lines(spark, sf_dir):
    return report.report_lines(analysis.ranked(_metrics(spark, sf_dir))).select(*(F.col(c).cast("long").alias(c) for c in ("rank", "ord", "sub")), "line")


@query(f"{_E}, {_SERIES} SELECT g, round(min(entropy), 6) + 0.0 AS e_min, round(max(entropy), 6) + 0.0 AS e_max, round(avg(entropy), 6) + 0.0 AS e_mean, round(greatest(max(entropy) - min(entropy), 0.5), 6) + 0.0 AS e_range FROM series GROUP BY g")
def chart_stats(spark, sf_dir):
    found = entropy.chart_stats(entropy.entropy_series(_merged(spark, sf_dir)))
    return found.select(_g(), *(r6(c).alias(c) for c in ("e_min", "e_max", "e_mean", "e_range")))


@query(f"""{_METRICS}, fracs AS (SELECT g, avg(pos / (n - 1)) AS mean_frac, string_agg(trunc(pos / (n - 1) * 100)::BIGINT || '%', '、' ORDER BY pos) AS places FROM t WHERE esc AND n > 1 GROUP BY g)
SELECT m.g, '回應延遲 P90 反映業務時間內團隊對客戶提問的回應速度。P90 越低代表 90% 的問題能在更短時間內被接收到回應。目前 P90 = ' || printf('%.0f', p90) || ' 分鐘，' || CASE WHEN s2 < 0.35 THEN '屬於優良水準，無需特別關注。' ELSE '已超過警示線，建議提升值班頻率。' END AS latency_insight,
 '負面情緒指標擷取客戶近 24 小時訊息中的負面語氣詞彙比例。' || CASE WHEN s4 >= 0.35 THEN '目前比例偏高，建議主動關懷客戶，確認核心訴求是否已被理解。' ELSE '目前情緒正常，持續維持良好溝通即可。' END AS mood_insight,
 CASE WHEN n >= 5 THEN CASE WHEN m.slope > 0.5 THEN '語義熵在對話後段明顯上升（slope=' || printf('%+.2f', m.slope) || '），對話主題持續擴散或情緒複雜化。' WHEN m.slope > 0.1 THEN '語義熵略有上升（slope=' || printf('%+.2f', m.slope) || '），對話內容輕微多元化，可持續觀察。'
  WHEN m.slope >= -0.1 THEN '語義熵維持穩定（slope=' || printf('%+.2f', m.slope) || '），對話聚焦、話題一致。' ELSE '語義熵在後段下降（slope=' || printf('%+.2f', m.slope) || '），對話收斂至特定主題。' END
  || CASE WHEN places IS NOT NULL THEN '  升級詞出現於對話 ' || places || ' 處（圖中紅色虛線）。' ELSE '' END
  || CASE WHEN m.peak > 0 AND abs(m.peak - mean_frac) < 0.2 THEN '  熵峰值與升級事件高度吻合，顯示升級前後對話出現明顯語義擴散。' ELSE '' END END AS trend_insight,
 CASE WHEN n >= 5 THEN CASE WHEN m.slope > 0.5 THEN 'red' WHEN m.slope > 0.1 THEN 'amber' WHEN m.slope >= -0.1 THEN 'green' ELSE 'blue' END END AS trend_color
FROM metrics m LEFT JOIN six ON six.g = m.g LEFT JOIN fracs ON fracs.g = m.g""")
def insight_texts(spark, sf_dir):
    return report.insights(_metrics(spark, sf_dir)).select(_g(), "latency_insight", "mood_insight", "trend_insight", "trend_color")


@query(f"{_METRICS} SELECT g FROM metrics WHERE trip OR score >= 0.3")
def llm_gate(spark, sf_dir):
    return issues.gate(_metrics(spark, sf_dir)).select(_g())


_BODY = "CASE WHEN is_sticker THEN '[貼圖]' ELSE text END"


@query(f"{_E} SELECT g, string_agg('[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || role || '] [' || msg_id || '] ' || sender || ': ' || {_BODY}, chr(10) ORDER BY seq) AS transcript FROM e GROUP BY g")
def transcripts(spark, sf_dir):
    return issues.transcripts(_merged(spark, sf_dir)).select(_g(), "transcript")


_ISSUE_ROWS = f"""k AS (SELECT DISTINCT g FROM m WHERE g % 7 IN (0, 1, 6)),
issues AS (SELECT g, o AS issue_ord, g || '-' || (o + 1) AS issue_id, CASE o WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'unclear' END AS status,
 CASE o WHEN 0 THEN TIMESTAMP '2025-09-01 10:00:00' + to_days((g % 5)::INT) ELSE TIMESTAMP '2025-09-01 08:30:00' + to_days((g % 4)::INT) END AS raised FROM k, (VALUES (0), (1), (2)) v(o))"""
_ISSUES = f"WITH {_CHAT}, {_ISSUE_ROWS}"
_OLDEST = f"""a AS (SELECT g, greatest(0.0, max((epoch_us({_NOW}) - epoch_us(raised)) / 60000000.0) FILTER (status <> 'resolved')) AS age, count(*) FILTER (status <> 'resolved') AS n FROM issues GROUP BY g),
i3 AS (SELECT g, age::DOUBLE AS age3, n AS open3, CASE WHEN age <= 0 THEN 0.0 ELSE {_severity('age', 60.0, 480.0)} END::DOUBLE AS s3 FROM a)"""


@query(f"{_ISSUES} SELECT g, issue_ord, issue_id, status, raised, CASE WHEN status = 'resolved' THEN '✅' ELSE '🔴' END AS icon, CASE WHEN status = 'resolved' THEN '已解決' ELSE '待處理' END AS tag, '請求' AS kind, row_number() OVER (PARTITION BY g ORDER BY status = 'resolved', issue_ord) AS shown FROM issues")
def i3_issues(spark, sf_dir):
    found, _ = issues.parse_replies(adapters.canned_replies(_raw(spark, sf_dir)))
    out = issues.issue_order(found).withColumn("shown", F.row_number().over(Window.partitionBy("group_key").orderBy("shown_ord", "issue_ord")))
    s = F.col("status")
    return out.select(_g(), F.col("issue_ord").cast("long").alias("issue_ord"), "issue_id", "status", issues.raised(F.col("raised_at")).alias("raised"), labels.issue_icon(s).alias("icon"), labels.issue_tag(s).alias("tag"), labels.issue_type(F.col("type")).alias("kind"), F.col("shown").cast("long").alias("shown"))


@query(f"{_ISSUES}, {_OLDEST} SELECT g, age3 AS oldest_age_min, open3 AS open_issues, round(s3, 6)::DOUBLE AS severity FROM i3")
def i3_oldest_open(spark, sf_dir):
    found, _ = issues.parse_replies(adapters.canned_replies(_raw(spark, sf_dir)))
    return issues.i3(found, _chat_now()).select(_g(), F.col("i3_oldest_age_min").alias("oldest_age_min"), F.col("i3_open_issues").cast("long").alias("open_issues"), r6("i3_severity").alias("severity"))


@query(f"WITH {_CHAT} SELECT DISTINCT g, CASE WHEN g % 7 IN (3, 4) THEN 'unusable reply' END AS error FROM m")
def i3_reply_status(spark, sf_dir):
    _, status = issues.parse_replies(adapters.canned_replies(_raw(spark, sf_dir)))
    return status.select(_g(), F.col("error").cast("string").alias("error"))


@query(f"""{_E} SELECT g, row_number() OVER (PARTITION BY g ORDER BY seq) - 1 AS issue_ord, ts AS raised, text AS summary, '問題' AS kind FROM e WHERE role = 'customer' AND NOT is_sticker AND contains(text, '？') AND NOT contains(text, chr(13))""")
def i3_extracted(spark, sf_dir):
    replies = analysis.once(issues.extract(issues.transcripts(_merged(spark, sf_dir)), adapters.asking_lines))
    found, _ = issues.parse_replies(replies)
    return found.select(_g(), F.col("issue_ord").cast("long").alias("issue_ord"), issues.raised(F.col("raised_at")).alias("raised"), "summary", labels.issue_type(F.col("type")).alias("kind"))


@query(f"""{_E}, said AS (SELECT g, string_agg('[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || role || '] [' || msg_id || '] ' || sender || ': ' || {_BODY}, chr(10) ORDER BY seq) AS transcript,
 count(*) FILTER (role = 'customer' AND NOT is_sticker AND contains(text, '？') AND NOT contains(text, chr(13))) AS n FROM e GROUP BY g)
SELECT g, sha256('12:asking-lines' || transcript) AS digest, n AS n_issues FROM said""")
def i3_ledger(spark, sf_dir):
    """Issues by way of the ledger: the first run pays for every transcript, the second finds all replies and would fail if it had to call."""
    texts, book = analysis.once(issues.transcripts(_merged(spark, sf_dir))), held.folder(spark)
    ledger.extract(texts, adapters.asking_lines, book, "asking-lines").write.format("noop").mode("overwrite").save()

    def never():
        raise RuntimeError("a call is made twice")

    again = analysis.once(ledger.extract(texts, never, book, "asking-lines"))
    found, status = issues.parse_replies(again)
    counts = found.groupBy("group_key").agg(F.count("*").alias("n_issues"))
    digests = texts.select("group_key", ledger.digest("asking-lines", F.col("transcript")).alias("digest"))
    kept = ledger.entries(spark, book).select("digest")
    good = status.filter("error is null").join(digests, "group_key").join(kept, "digest", "left_semi")
    return good.join(counts, "group_key", "left").select(_g(), "digest", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


@query(f"""{_ISSUES} SELECT g, issue_ord, '{{"cost":17,"owner":{{"floors":[1,2.5],"team":"blue"}}}}' AS other FROM issues WHERE status = 'resolved'""")
def i3_other_fields(spark, sf_dir):
    """Fields that an extractor adds on its own are kept."""
    found, _ = issues.parse_replies(adapters.canned_replies(_raw(spark, sf_dir)))
    return found.select(_g(), F.col("issue_ord").cast("long").alias("issue_ord"), issues.other_fields().alias("other")).filter("other is not null")


_FULL = f"""{_METRICS.replace(" metrics AS", " before_issues AS").replace("metrics AS (", "before_issues AS (")}, {_ISSUE_ROWS}, {_OLDEST},
metrics AS (SELECT x.*, coalesce(s3, 0.0) AS s3, coalesce(age3, 0.0) AS age3, coalesce(open3, 0) AS open3,
 CASE WHEN trip THEN greatest(0.35 * s1 + 0.2 * s2 + 0.15 * coalesce(s3, 0.0) + 0.3 * s4, 0.95) ELSE 0.35 * s1 + 0.2 * s2 + 0.15 * coalesce(s3, 0.0) + 0.3 * s4 END::DOUBLE AS score FROM x LEFT JOIN i3 ON i3.g = x.g),
o AS (SELECT *, row_number() OVER (ORDER BY trip DESC, score DESC, g) AS rank FROM metrics)"""


def _with_issues(spark, sf_dir):
    """Messages, ranked metrics with I3, and the issues of canned replies."""
    messages = analysis.once(_merged(spark, sf_dir))
    found, _ = issues.parse_replies(adapters.canned_replies(messages))
    metrics = analysis.group_metrics(messages, _chat_now(), messages.select("group_key", "group_id").distinct())
    return messages, analysis.ranked(analysis.with_issues(metrics, found, _chat_now())), found


@query(f"{_FULL} SELECT rank, g, round(s3, 6)::DOUBLE AS i3_severity, age3::DOUBLE AS i3_oldest_age_min, open3 AS i3_open_issues, round(score, 6)::DOUBLE AS composite FROM o")
def metrics_with_issues(spark, sf_dir):
    _, ranked, _ = _with_issues(spark, sf_dir)
    return ranked.select(F.col("rank").cast("long").alias("rank"), _g(), r6("i3_severity").alias("i3_severity"), "i3_oldest_age_min", F.col("i3_open_issues").cast("long").alias("i3_open_issues"), r6("composite").alias("composite"))


_SAID = """printf('%.0f', p90)"""
_LATENCY = f"""'回應延遲 P90 反映業務時間內團隊對客戶提問的回應速度。P90 越低代表 90% 的問題能在更短時間內被接收到回應。目前 P90 = ' || {_SAID} || ' 分鐘，' || CASE WHEN s2 < 0.35 THEN '屬於優良水準，無需特別關注。' ELSE '已超過警示線，建議提升值班頻率。' END"""
_MOOD = "'負面情緒指標擷取客戶近 24 小時訊息中的負面語氣詞彙比例。' || CASE WHEN s4 >= 0.35 THEN '目前比例偏高，建議主動關懷客戶，確認核心訴求是否已被理解。' ELSE '目前情緒正常，持續維持良好溝通即可。' END"
_TREND = """CASE WHEN o.slope > 0.5 THEN '語義熵在對話後段明顯上升（slope=' || printf('%+.2f', o.slope) || '），對話主題持續擴散或情緒複雜化。' WHEN o.slope > 0.1 THEN '語義熵略有上升（slope=' || printf('%+.2f', o.slope) || '），對話內容輕微多元化，可持續觀察。'
  WHEN o.slope >= -0.1 THEN '語義熵維持穩定（slope=' || printf('%+.2f', o.slope) || '），對話聚焦、話題一致。' ELSE '語義熵在後段下降（slope=' || printf('%+.2f', o.slope) || '），對話收斂至特定主題。' END
  || CASE WHEN places IS NOT NULL THEN '  升級詞出現於對話 ' || places || ' 處（圖中紅色虛線）。' ELSE '' END
  || CASE WHEN o.peak > 0 AND abs(o.peak - mean_frac) < 0.2 THEN '  熵峰值與升級事件高度吻合，顯示升級前後對話出現明顯語義擴散。' ELSE '' END"""


@query(f"""{_FULL}, fracs AS (SELECT g, avg(pos / (n - 1)) AS mean_frac, string_agg(trunc(pos / (n - 1) * 100)::BIGINT || '%', '、' ORDER BY pos) AS places FROM t WHERE esc AND n > 1 GROUP BY g),
state AS (SELECT g, count(*) AS n, count(*) FILTER (status <> 'resolved') AS still, count(*) FILTER (status = 'resolved') AS done FROM issues GROUP BY g)
SELECT rank, 'bars' AS section, 0::BIGINT AS ord, printf('I1 未回應提問  severity %.2f  |  最老 %.0f 分鐘', s1::DOUBLE, age1) AS text FROM o
UNION ALL SELECT rank, 'bars', 1, printf('I2 回應延遲  severity %.2f  |  P90 = %.0f 分鐘', s2::DOUBLE, p90) FROM o
UNION ALL SELECT rank, 'bars', 2, printf('I4 負面情緒  severity %.2f  |  負面比 %.1f%%', s4::DOUBLE, r4 * 100) FROM o
UNION ALL SELECT rank, 'bars', 3, printf('綜合分數  composite %.3f', score) FROM o
UNION ALL SELECT rank, 'latency', 0, printf('P90 延遲：%.0f 分鐘（警示線 120 分 / 臨界線 480 分）', p90) FROM o
UNION ALL SELECT rank, 'latency', 1, {_LATENCY} FROM o
UNION ALL SELECT rank, 'sentiment', 0, printf('近 24 小時客戶訊息中，%.1f%% 帶有負面詞彙（severity = %.2f）。', r4 * 100, s4::DOUBLE) FROM o
UNION ALL SELECT rank, 'sentiment', 1, {_MOOD} FROM o
UNION ALL SELECT rank, 'entropy', 0, printf('字元 bigram Shannon 熵（bits）隨對話進展的變化。  均值 %.2f bits，熵峰值出現於對話 %d%% 處。', o.mean, trunc(o.peak * 100)::BIGINT) FROM o JOIN six ON six.g = o.g WHERE six.n >= 5
UNION ALL SELECT rank, 'entropy', 1, {_TREND} FROM o JOIN six ON six.g = o.g LEFT JOIN fracs ON fracs.g = o.g WHERE six.n >= 5
UNION ALL SELECT rank, 'issues', 0, printf('共 %d 個議題：%d 個待處理、%d 個已解決。最老未解議題年齡：%.0f 分鐘。', state.n, still, done, age3::DOUBLE) FROM o JOIN state ON state.g = o.g
UNION ALL SELECT rank, 'issues', 1, printf('共 %d 項議題尚未定案。建議在下次客戶接觸前整理待確認清單，逐項確認後關閉。', still) FROM o JOIN state ON state.g = o.g
UNION ALL SELECT rank, 'action', 0, '【今日跟進】' || g || '｜' || coalesce(nullif(concat_ws('、', CASE WHEN s2 >= 0.5 THEN printf('回應延遲 P90=%.0f 分', p90) END, CASE WHEN s1 >= 0.3 THEN printf('未回覆提問 %d 個（最老 %.0f 分）', open1, age1) END,
  CASE WHEN s4 >= 0.3 THEN printf('負面情緒比 %.0f%%', r4 * 100) END), ''), printf('綜合分數 %.2f', score)) || '，建議今日內主動聯繫客戶確認狀態。' FROM o WHERE NOT trip AND score >= 0.15""")
def report_texts(spark, sf_dir):
    """Every sentence of the page, issues included."""
    _, ranked, found = _with_issues(spark, sf_dir)
    return report.report_texts(ranked, found).select(F.col("rank").cast("long").alias("rank"), "section", F.col("ord").cast("long").alias("ord"), "text")


@query(f"""{_FULL} SELECT rank, 4::BIGINT AS ord, 0::BIGINT AS sub, printf('    I3 最老未解議題: severity=%.2f  開放=%d個  最老=%.0f分', s3, open3, age3::DOUBLE) AS line FROM o WHERE g IN (SELECT g FROM issues)
UNION ALL SELECT rank, 5, issue_ord, '       ' || CASE WHEN status = 'resolved' THEN '✅' ELSE '🔴' END || ' [request] s ' || o.g FROM issues JOIN o ON o.g = issues.g""")
def report_lines_issues(spark, sf_dir):
    """The lines on issues in the text report."""
    _, ranked, found = _with_issues(spark, sf_dir)
    return report.report_lines(ranked, found).filter(F.col("ord").isin(4, 5)).select(*(F.col(c).cast("long").alias(c) for c in ("rank", "ord", "sub")), "line")


@query(f"""{_FULL}, one_each AS (SELECT rank, unnest([('a-header', 'header'), ('c-metrics', 'cards'), ('d-latency', 'insight'), ('e-sentiment', 'insight')]) AS b FROM o),
reasons AS (SELECT g FROM e WHERE esc UNION ALL SELECT g FROM one WHERE i1_oldest_age_min >= 480),
all_blocks AS (SELECT 0 AS rank, 'cards' AS section, 'overview' AS kind UNION ALL SELECT 0, 'ranking', 'row' FROM o
 UNION ALL SELECT 0, CASE WHEN trip THEN 'actions' WHEN score < 0.15 THEN 'actions-ok' ELSE 'actions-watch' END, CASE WHEN trip THEN 'red' WHEN score < 0.15 THEN 'ok' ELSE 'watch' END FROM o
 UNION ALL SELECT rank, b[1], b[2] FROM one_each UNION ALL SELECT rank, 'b-tripwire', 'reason' FROM reasons JOIN o USING (g)
 UNION ALL SELECT rank, 'd-latency', 'example' FROM (SELECT DISTINCT g FROM pairs) JOIN o USING (g)
 UNION ALL SELECT rank, 'e-sentiment', 'example' FROM (SELECT g, row_number() OVER (PARTITION BY g ORDER BY seq) AS k FROM e WHERE role = 'customer' AND sentiment < -0.1 AND NOT is_sticker) q JOIN o USING (g) WHERE k <= 3
 UNION ALL SELECT rank, 'f-entropy', 'point' FROM series s JOIN o ON o.g = s.g WHERE s.n >= 5
 UNION ALL SELECT rank, 'f-entropy', 'trend' FROM six JOIN o ON o.g = six.g WHERE six.n >= 5
 UNION ALL SELECT rank, 'g-issues', 'issue' FROM issues JOIN o ON o.g = issues.g)
SELECT rank, section, kind, count(*) AS n FROM all_blocks GROUP BY ALL""")
def report_outline(spark, sf_dir):
    """How many blocks of each kind every section of the report has."""
    return report.report_blocks(*_with_issues(spark, sf_dir)).groupBy(F.col("rank").cast("long").alias("rank"), "section", "kind").agg(F.count("*").alias("n"))


@query()
def report_blocks(spark, sf_dir):
    return report.report_blocks(*_with_issues(spark, sf_dir))


@query(f"""{_RANKED}, reasons AS (SELECT g FROM e WHERE esc UNION ALL SELECT g FROM one WHERE i1_oldest_age_min >= 480), why AS (SELECT g, count(*) AS k FROM reasons GROUP BY g)
SELECT o.g || '.txt' AS source_file, 'OK' AS status, NULL::VARCHAR AS error, coalesce(k, 0) AS n_tripwire, round(score, 6)::DOUBLE AS composite FROM o LEFT JOIN why ON why.g = o.g
UNION ALL SELECT 'x' || g || '.txt', 'ERROR', 'impossible date or time', NULL, NULL FROM o WHERE g % 10 = 9 UNION ALL SELECT 'y' || g || '.txt', 'ERROR', 'not UTF-8', NULL, NULL FROM o WHERE g % 10 = 9""")
def export_folder(spark, sf_dir):
    """The whole way over files: exports and staff list written, listed, parsed, ranked; the log has every file, spoiled ones too."""
    chats, staff = adapters.write_exports(_raw(spark, sf_dir), held.folder(spark))
    ranked, _, status, _ = cli.run(spark, chats, staff, datetime.fromisoformat(adapters.CHAT_NOW))
    return report.file_status(status, ranked).select("source_file", "status", "error", F.col("n_tripwire").cast("long").alias("n_tripwire"), r6("composite").alias("composite"))


@query(f"""{_FULL}, esc AS (SELECT g, count(*) AS n FROM t WHERE esc AND n > 1 GROUP BY g), points AS (SELECT g, count(*) AS n FROM series WHERE n >= 5 GROUP BY g), state AS (SELECT g, count(*) AS n FROM issues GROUP BY g),
reasons AS (SELECT g, count(*) AS n FROM (SELECT g FROM e WHERE esc UNION ALL SELECT g FROM one WHERE i1_oldest_age_min >= 480) GROUP BY g)
SELECT rank, o.g::VARCHAR AS name, 4::BIGINT AS n_bars, coalesce(reasons.n, 0) AS n_reasons, coalesce(state.n, 0) AS n_issues, coalesce(points.n, 0) AS n_points, CASE WHEN points.n IS NULL THEN 0 ELSE coalesce(esc.n, 0) END AS n_escalations
FROM o LEFT JOIN reasons ON reasons.g = o.g LEFT JOIN state ON state.g = o.g LEFT JOIN points ON points.g = o.g LEFT JOIN esc ON esc.g = o.g""")
def report_pages(spark, sf_dir):
    """What the groups' pages show, read back from the files that tasks wrote."""
    messages, ranked, found = _with_issues(spark, sf_dir)
    folder = report.write_pages(messages, ranked, held.folder(spark), found, at=datetime.fromisoformat(adapters.CHAT_NOW))
    page = F.col("value")
    count = lambda mark: F.regexp_count(page, F.lit(mark)).cast("long")
    line = F.regexp_extract(page, " points='([^']*)'", 1)
    return spark.read.option("pathGlobFilter", "group-*.html").text(folder, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"group-(\d+)", 1).cast("long").alias("rank"),
        F.regexp_extract(page, "group_id: <b>([^<]*)</b>", 1).alias("name"),
        count("class='bar'").alias("n_bars"),
        count("<p>reason: <b>").alias("n_reasons"),
        count("<p>summary: <b>").alias("n_issues"),
        F.when(line == "", F.lit(0).cast("long")).otherwise(F.size(F.split(line, " ")).cast("long")).alias("n_points"),
        count("class='escalation'").alias("n_escalations"),
    )


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
