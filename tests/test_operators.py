"""Operators against plain loops on random chats."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatvitals.config import Vitals
from chatvitals.functions.text import bigram_bits, long_text_bits
from chatvitals.operators import entropy, indicators, issues, lanes
from chatvitals.operators.merge import merge_fragments
from chatvitals.plans import analysis

NOW = datetime(2025, 9, 5, 17)
RAW = "group_key long, group_id string, seq long, msg_id string, sender string, role string, ts timestamp_ntz, text string, is_sticker boolean, is_image boolean"
ACTS = RAW + ", dialogue_act string, sentiment double, is_escalation_marker boolean"


def chats(seed, groups=12, n=40):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        ts = datetime(2025, 9, 1, 8) + timedelta(hours=g)
        for k in range(rnd.randrange(1, n)):
            ts += timedelta(seconds=rnd.choice([-90, 0, 20, 40, 61, 400, 9000, 90000, 400000]))
            staff = rnd.random() < 0.4
            sticker, image = rnd.random() < 0.1, rnd.random() < 0.05
            sticker, image = sticker, image and not sticker
            rows.append((g, f"g{g}", k, f"g{g}_{k:05d}", rnd.choice("xy") if staff else rnd.choice("ab"), "staff" if staff else "customer", ts, "" if sticker or image else rnd.choice(["aab", "好", "hello 你", "退費"]), sticker, image))
    return rows


def tagged(seed):
    rnd = random.Random(seed)
    return [(*r, rnd.choice(["question", "request", "answer", "ack"]), rnd.choice([-1.0, -0.1, 0.0, 1.0]), rnd.random() < 0.05) for r in chats(seed)]


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_merge(spark):
    rows = chats(1)
    want = []
    for ms in by_group(rows).values():
        held = None
        for m in ms:
            if held is not None and m[4] == held[4] and not (m[8] or m[9] or held[8] or held[9]) and (m[6] - held[6]).total_seconds() <= 60:
                held[7] += " " + m[7]
            else:
                held = list(m)
                want.append(held)
    got = merge_fragments(spark.createDataFrame(rows, RAW)).collect()
    assert sorted(map(tuple, got)) == sorted((*m[:7], m[7].strip(), *m[8:]) for m in want)


def test_fragments_anchor_on_the_first(spark):
    t = datetime(2025, 9, 1, 9)
    rows = [(1, "g", k, f"m{k}", "a", "customer", t + timedelta(minutes=k), str(k), False, False) for k in range(4)]
    assert [r["text"] for r in merge_fragments(spark.createDataFrame(rows, RAW)).orderBy("seq").collect()] == ["0 1", "2 3"]


def test_replies_and_latency(spark):
    rows = tagged(2)
    open_, lat, first = Counter(), {}, {}
    for g, ms in by_group(rows).items():
        for i, m in enumerate(ms):
            if m[5] != "customer" or m[10] not in ("question", "request"):
                continue
            later = next((x for x in ms[i + 1 :] if x[5] == "staff"), None)
            if later is None:
                open_[g] += 1
                continue
            if not m[8] and g not in first:
                first[g] = (m[2], later[6])
            for x in ms[i + 1 :]:
                if (x[6] - m[6]).days > 3:
                    break
                if x[5] == "staff":
                    lat[g, m[2]] = x[2]
                    break
    df = spark.createDataFrame(rows, ACTS)
    now = analysis.clock(NOW)
    assert {r["group_key"]: r["i1_open_questions"] for r in indicators.i1(df, now).collect()} == dict(open_)
    found = indicators.latencies(df).collect()
    assert {(r["group_key"], r["seq"]): r["reply_seq"] for r in found} == lat
    values = {}
    for r in found:
        values.setdefault(r["group_key"], []).append(r["latency_min"])
    want = {g: sorted(v)[min(int(len(v) * 0.9), len(v) - 1)] for g, v in values.items()}
    assert {r["group_key"]: r["i2_p90_min"] for r in indicators.i2(df).collect()} == want
    assert {r["group_key"]: r["reply_ts"] for r in indicators.latency_example(df).collect()} == {g: t for g, (_, t) in first.items()}


def test_entropy_series(spark):
    rows = tagged(3)
    want = {}
    for g, ms in by_group(rows).items():
        texts = [m[7] for m in ms if m[7] and not m[8]]
        if len(texts) < 2:
            continue
        for i in range(len(texts)):
            c = Counter(t[k : k + 2] for t in texts[max(0, i - 4) : i + 1] for k in range(len(t) - 1))
            n = sum(c.values())
            want[g, i] = -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0
    series = entropy.entropy_series(spark.createDataFrame(rows, ACTS))
    got = {(r["group_key"], r["pos"]): r["entropy"] for r in series.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for r in entropy.i6(series).collect():
        v = [want[k] for k in sorted(want) if k[0] == r["group_key"]]
        half = len(v) // 2
        assert r["i6_mean_entropy"] == pytest.approx(sum(v) / len(v))
        assert r["i6_entropy_slope"] == pytest.approx(sum(v[half:]) / (len(v) - half) - sum(v[:half]) / half)
        assert r["i6_peak_entropy_frac"] == pytest.approx([round(x, 9) for x in v].index(max(round(x, 9) for x in v)) / (len(v) - 1))


def test_sliding_multiset():
    rnd, held, last = random.Random(9), entropy.Multiset(), []
    for _ in range(400):
        text = "".join(rnd.choice("ab好😂") for _ in range(rnd.randrange(9)))
        last.append(text)
        held.move(entropy.Multiset.of(text), 1)
        if len(last) > 7:
            held.move(entropy.Multiset.of(last.pop(0)), -1)
        n = Counter(t[i : i + 2] for t in last for i in range(len(t) - 1))
        want = -sum(c / n.total() * math.log2(c / n.total()) for c in n.values()) if n else 0.0
        assert abs(held.bits() - want) < 1e-12 and held.total == n.total() and len(held.counts) == len(n)


def test_long_windows_and_stretches(spark):
    rnd = random.Random(10)
    rows = [(1, k, "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 12))), NOW, False) for k in range(300)]
    df = spark.createDataFrame(rows, "group_key int, seq long, text string, ts timestamp_ntz, is_sticker boolean").repartition(3)
    cfg = Vitals(entropy_window=50, lane_rows=60)
    plain = {r["pos"]: r["entropy"] for r in entropy.entropy_series(df, cfg).collect()}
    laned = {r["pos"]: r["entropy"] for r in entropy.entropy_series(lanes.assign(df, cfg.lane_rows), cfg).collect()}
    for i in (0, 1, 48, 49, 50, 59, 60, 61, 109, 200, 299):
        n = Counter(t[k : k + 2] for _, _, t, _, _ in rows[max(0, i - 49) : i + 1] for k in range(len(t) - 1))
        assert plain[i] == laned[i] and abs(plain[i] - (-sum(c / n.total() * math.log2(c / n.total()) for c in n.values()) if n else 0.0)) < 1e-9
    assert plain == laned and len(plain) == 300


def test_group_without_messages_has_defaults(spark):
    df = spark.createDataFrame(tagged(4), ACTS)
    groups = spark.createDataFrame([(999, "empty")], "group_key long, group_id string")
    r = analysis.group_metrics(df, analysis.clock(NOW), groups).first()
    assert r["i6_peak_entropy_frac"] == 0.5 and r["composite"] == 0.0 and r["tripwire"] is False and r["i5_msg_count_24h"] == 0


def test_tripwire_outranks(spark):
    df = spark.createDataFrame([(*r[:10], "answer", 0.0, r[0] == 5) for r in chats(5)], ACTS)
    top = analysis.ranked(analysis.group_metrics(df, analysis.clock(NOW), df.select("group_key", "group_id").distinct())).orderBy("rank").first()
    assert top["tripwire"] and top["composite"] >= 0.95


def test_aware_clock_is_refused():
    from datetime import timezone

    with pytest.raises(ValueError):
        analysis.clock(datetime(2025, 1, 1, tzinfo=timezone.utc))


def test_replies_of_an_extractor(spark):
    good = '{"issues": [{"status": "unclear", "raised_at": "2025-09-05T10:00:00Z", "summary": "s"}, {"status": "resolved", "raised_at": null}, {"summary": "no status"}]}'
    rows = [(0, good), (1, "see: " + good + " ok"), (2, "nothing"), (3, "{broken}"), (4, "[1]"), (5, None), (6, '{"issues": [{"status": "unclear", "raised_at": null}]}'), (7, '{"issues": []}'), (8, '{"issues": null}'), (9, '{"issues": [{"status": "unresolved", "raised_at": "20250905T010000"}]}'), (10, '{"issues": [{"status": "unresolved", "raised_at": "soon"}]}')]
    found, status = issues.parse_replies(spark.createDataFrame(rows, "group_key int, reply string"))
    bad = {r["group_key"] for r in status.collect() if r["error"]}
    assert bad == {3, 4, 5, 6, 8}
    ages = {r["group_key"]: (r["i3_oldest_age_min"], r["i3_open_issues"], r["i3_severity"]) for r in issues.i3(found, analysis.clock(NOW)).collect()}
    assert ages == {0: (420.0, 1, pytest.approx(360 / 420)), 1: (420.0, 1, pytest.approx(360 / 420)), 9: (960.0, 1, 1.0), 10: (0.0, 1, 0.0)}


def test_extractor_runs_once_per_group(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "boom")], "group_key int, transcript string")

    def make():
        def call(t):
            if t == "boom":
                raise RuntimeError(t)
            return t.upper()

        return call

    replies = issues.extract(texts, make).cache()
    assert {r["group_key"]: (r["reply"], r["failure"]) for r in replies.collect()} == {1: ("A", None), 2: (None, "RuntimeError: boom")}
    _, status = issues.parse_replies(replies)
    assert {r["group_key"]: r["error"] for r in status.collect()} == {1: None, 2: "RuntimeError: boom"}


def _merged(rows, limit=60):
    """(seq, text) by a plain loop; rows: (seq, sender, seconds, text, special)."""
    out, last = [], None
    for seq, sender, at, text, special in rows:
        if last and not special and not last[3] and sender == last[1] and at - last[2] <= limit:
            out[-1] = (out[-1][0], out[-1][1] + " " + text)
        else:
            out.append((seq, text))
            last = (seq, sender, at, special)
        last = (last[0], sender, last[2], special)
    return out


def test_merge_of_long_bursts(spark):
    rnd, rows, at = random.Random(3), [], 0
    for seq in range(1500):
        at += rnd.choice([-70, -5, 0, 1, 20, 20, 30, 59, 61, 200])
        rows.append((seq, "a" if rnd.random() < 0.95 else "b", at, f"t{seq}", rnd.random() < 0.02))
    df = spark.createDataFrame([(1, s, who, NOW + timedelta(seconds=at), t, special, False) for s, who, at, t, special in rows], "group_key int, seq long, sender string, ts timestamp_ntz, text string, is_sticker boolean, is_image boolean")
    got = sorted((r["seq"], r["text"]) for r in merge_fragments(df).collect())
    assert got == _merged(rows)


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa", "abab", "好的好的嗎", "mississippi mississippi"])
def test_bits_inside_a_row(spark, text):
    n = Counter(text[i : i + 2] for i in range(len(text) - 1))
    want = -sum(c / n.total() * math.log2(c / n.total()) for c in n.values()) if n else 0.0
    assert spark.createDataFrame([(text,)], "t string").select(bigram_bits(F.col("t")).alias("b"), long_text_bits(F.col("t")).alias("l")).first() == (pytest.approx(want), pytest.approx(want))
