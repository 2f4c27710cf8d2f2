from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from chatvitals.config import NEGATIVE, POSITIVE, Vitals
from chatvitals.functions import labels, rules, service_time, text
from chatvitals.plans import report
from chatvitals.sources.adapters import PHRASES

ACTS = ["question", "request", "answer", "ack", "ack", "report", "chit_chat", "ack", "ack", "question", "answer", "chit_chat", "request", "ack", "ack"]


def test_phrases(spark):
    rows = [(i, p, p == "貼圖", p == "圖片") for i, p in enumerate(PHRASES)]
    df = rules.enrich(spark.createDataFrame(rows, "i int, text string, is_sticker boolean, is_image boolean"))
    got = {r["i"]: r for r in df.collect()}
    assert [got[i]["dialogue_act"] for i in range(15)] == ACTS
    assert got[10]["sentiment"] == -1.0 and got[4]["sentiment"] == 1.0 and got[0]["sentiment"] == 0.0
    assert [i for i in got if got[i]["is_escalation_marker"]] == [2]


def test_full_width_space_counts_as_space(spark):
    df = spark.createDataFrame([("好　", False, False), ("", False, False)], "text string, is_sticker boolean, is_image boolean")
    assert [r["dialogue_act"] for r in rules.enrich(df).collect()] == ["ack", "chit_chat"]


def test_lexicons():
    assert len(NEGATIVE) == 69 and len(set(NEGATIVE)) == 68 and len(POSITIVE) == 15


def test_sentiment_is_presence_with_duplicates(spark):
    got = spark.createDataFrame([("不合理好的",), ("",), ("好的好的",)], "t string").select(rules.sentiment(F.col("t"))).collect()
    assert [r[0] for r in got] == [pytest.approx(-1 / 3), 0.0, 1.0]


def _slow_minutes(a, b):
    n = 0
    while a < b:
        n += a.weekday() < 5 and 9 <= a.hour < 18
        a += timedelta(minutes=1)
    return n


def test_service_minutes(spark):
    rnd = random.Random(3)
    pairs = [(datetime(2025, 9, 4, 23), datetime(2025, 9, 5, 9, 30)), (datetime(2025, 9, 5, 9), datetime(2025, 9, 5, 9)), (datetime(2025, 9, 6), datetime(2025, 9, 5)), (datetime(1969, 12, 30, 8), datetime(1970, 1, 6, 12))]
    for _ in range(120):
        a = datetime(2025, 8, 30) + timedelta(seconds=rnd.randrange(10**6), microseconds=rnd.randrange(10**6))
        pairs.append((a, a + timedelta(seconds=rnd.randrange(-5000, 800000), microseconds=rnd.randrange(10**6))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = {r["i"]: r["m"] for r in df.select("i", service_time.service_minutes(F.col("a"), F.col("b")).alias("m")).collect()}
    assert [got[i] for i in range(len(pairs))] == [_slow_minutes(a, b) for a, b in pairs]
    assert got[0] == 30


def test_severities(spark):
    df = spark.createDataFrame([(x,) for x in (29.0, 30.0, 195.0, 360.0)], "x double")
    assert [r[0] for r in df.select(service_time.age_to_severity(F.col("x"), 30, 360)).collect()] == [0, 0, 0.5, 1]
    df = spark.createDataFrame([(x,) for x in (0.1, 0.35, 0.6)], "x double")
    assert [r[0] for r in df.select(service_time.ratio_severity(F.col("x"))).collect()] == pytest.approx([0, 0.5, 1])


def test_text_helpers_match_python(spark):
    samples = ["a\r\nb\x0bc d\n", "", "\n", "x\x1cy", "　 a \x85", "👍b", "ab"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    c = F.col("s")
    for r in df.select("s", text.lines(c).alias("l"), text.strip(c).alias("p"), text.rstrip(c).alias("r"), text.bigrams(c).alias("b")).collect():
        s = r["s"]
        assert (r["l"], r["p"], r["r"]) == (s.splitlines(), s.strip(), s.rstrip())
        assert r["b"] == [s[i : i + 2] for i in range(len(s) - 1)]


def test_hours_can_be_set(spark):
    df = spark.createDataFrame([(datetime(2025, 9, 1, 8), datetime(2025, 9, 1, 9))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(service_time.service_minutes(F.col("a"), F.col("b"), Vitals(service_open=8))).first()[0] == 60


def test_printed_numbers_are_those_of_printf(spark):
    """The binary value decides (0.155 is below its decimals), ties go to the even digit, and what rounds to zero from below keeps its sign."""
    r = random.Random(7)
    values = [0.155, 0.145, 0.125, 0.375, 2.675, 1.005, -0.003, -0.0, 0.0, -0.005, 0.995, 99.95, 0.5, 1.5, 2.5, -2.5, 1e-9, -1e-320, 123456789.125]
    values += [r.randrange(-2000, 2000) / 1000 for _ in range(300)] + [r.uniform(-3, 3) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in range(4):
        form = f"%+.{digits}f"
        got = df.select(F.format_string(form, labels.printed(F.col("v"), digits)).alias("x")).collect()
        assert [x[0] for x in got] == [form % v for v in values]
    assert df.select(labels.trend_text(F.lit(-0.003)).alias("x")).first()[0] == "語義熵維持穩定（slope=-0.00），對話聚焦、話題一致。"


def test_report_lines_show_the_sign_of_what_rounds_to_zero(spark):
    df = spark.createDataFrame([(6.475, -0.003, 57, "s")], "i6_mean_entropy double, i6_entropy_slope double, peak_pct int, slope_label string")
    (line,) = (report._line(text, columns) for o, text, columns, _ in report.LINES if o == 8)
    assert df.select(line).first()[0] == "    I6 語義熵: mean=%.2fbits  slope=%+.2f  峰值@對話57%%  [s]" % (6.475, -0.003)


def test_a_filter_computes_the_text_once(spark):
    """A filter on sentiment or escalation pulls in what the text is made of; a loop over words must not compute it for each word."""
    df = spark.createDataFrame([(" 不合理 ", False, False), (None, False, False)], "raw string, is_sticker boolean, is_image boolean").withColumn("text", text.strip(F.col("raw")))
    for condition in ("sentiment < -0.1", "is_escalation_marker"):
        plan = rules.enrich(df).filter(condition).select("is_sticker")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1
    assert [r["raw"] for r in rules.enrich(df).filter("sentiment < -0.1").collect()] == [" 不合理 "]
