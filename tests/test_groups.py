"""Growing groups against the batch analysis."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatvitals.config import Vitals
from chatvitals.functions.rules import enrich
from chatvitals.functions.service_time import service_minutes
from chatvitals.plans import analysis
from chatvitals.sources import exports
from chatvitals.sources.adapters import PHRASES
from chatvitals.streaming import groups

NOW = datetime(2025, 9, 5, 17)


def chat(seed, n, name=None):
    rnd, out, at = random.Random(seed), [f"[LINE] {name}"] if name else [], datetime(2025, 8, 28, 9)
    out.append("08:00\tAmy\tbefore any date")
    day = None
    for _ in range(n):
        at += timedelta(minutes=rnd.choice([-40, 0, 0, 1, 1, 2, 30, 200, 1500]))
        if at.date() != day:
            day = at.date()
            out.append(f"{day:%Y.%m.%d} 星期一")
        who = rnd.choice(["Amy", "Amy", "Cid", "Bob", "系統訊息"])
        out.append(rnd.choice(["not a line", f"{at:%H:%M}\t{who}\t{rnd.choice(PHRASES)}", f"{at:%H:%M}\t{who}\t{rnd.choice(PHRASES)}", f"{at:%H:%M}\t{who}\t  hello {rnd.randrange(9)} "]))
    return out


CHATS = {"a": chat(1, 120, "群組 A"), "b": chat(2, 60), "c": chat(3, 3), "d": [], "e": chat(4, 200), "bad": ["2025.09.05 星期五", "09:00\tAmy\thi", "25:00\tAmy\tx", "09:01\tAmy\tho"]}
SAME = ["group_id", "i1_open_questions", "i1_oldest_age_min", "i1_severity", "i2_p90_min", "i2_severity", "i4_neg_ratio", "i4_severity", "i5_msg_count_24h", "i6_mean_entropy", "i6_entropy_slope", "i6_peak_entropy_frac", "i6_points", "i6_escalation_fracs", "tripwire_reasons", "tripwire", "composite"]


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, groups.PROVIDER)
    yield spark
    spark.conf.unset(name)


def rounded(row):
    return {c: [round(x, 9) if isinstance(x, float) else x for x in row[c]] if isinstance(row[c], list) else round(row[c], 9) if isinstance(row[c], float) else row[c] for c in SAME}


def test_ten_pieces_are_the_batch(rocks, tmp_path):
    whole, pieces = tmp_path / "whole", tmp_path / "pieces"
    whole.mkdir()
    pieces.mkdir()
    (tmp_path / "staff").write_text("Bob\n")
    for k, rows in CHATS.items():
        (whole / f"{k}.txt").write_text("".join(r + "\n" for r in rows), encoding="utf-8")
    raw, status = exports.parse(exports.scan_conversations(rocks, str(whole)), exports.load_staff(rocks, str(tmp_path / "staff")))
    found = status.filter("error is null").select("group_key", "group_id")
    want = {r["group_key"].removesuffix(".txt"): rounded(r) for r in analysis.group_metrics(analysis.prepare(raw), analysis.clock(NOW), found).collect()}
    seen, rnd = {}, random.Random(5)
    cuts = {k: sorted(rnd.randrange(len(rows) + 1) for _ in range(9)) for k, rows in CHATS.items()}
    for step in range(10):
        for k, rows in CHATS.items():
            part = rows[cuts[k][step - 1] if step else 0 : cuts[k][step] if step < 9 else len(rows)]
            (pieces / f"{k}@{step}.txt").write_text("".join(r + "\n" for r in part), encoding="utf-8")
        if step % 3 == 0:  # some micro-batches hold several pieces
            groups.watch(rocks, str(pieces), str(tmp_path / "staff"), lambda: NOW, lambda df, n: seen.update({r["group_key"]: r for r in df.collect()}), str(tmp_path / "state"), once=True).awaitTermination()
    assert want.pop("d")["composite"] == 0.0  # no line of it has come
    assert seen.keys() == CHATS.keys() - {"d"} and seen.pop("bad")["error"] == "impossible date or time"
    assert all(r["error"] is None for r in seen.values())
    got = {k: rounded(r) for k, r in seen.items()}
    assert [(k, c, got[k][c], want[k][c]) for k in want for c in SAME if got[k][c] != want[k][c]] == []


def test_pieces_out_of_order_fail(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "staff").write_text("Bob\n")
    seen = {}

    def run():
        groups.watch(rocks, str(tmp_path / "in"), str(tmp_path / "staff"), lambda: NOW, lambda df, n: seen.update({r["group_key"]: r["error"] for r in df.collect()}), str(tmp_path / "state"), once=True).awaitTermination()

    (tmp_path / "in" / "g@2.txt").write_text("2025.09.05 星期五\n")
    (tmp_path / "in" / "h@0.txt").write_bytes(b"\xff\xfe")
    run()
    assert seen == {"g": None, "h": "not UTF-8"}
    (tmp_path / "in" / "g@1.txt").write_text("09:00\tAmy\thi\n")
    run()
    assert seen["g"] == "piece out of order"


def test_timer_scores_again(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "staff").write_text("Bob\n")
    (tmp_path / "in" / "g@0.txt").write_text("2025.09.05 星期五\n09:00\tAmy\t請問可以嗎？\n", encoding="utf-8")
    ages = []

    class Soon(groups.Scorer):
        def _again(self, ms):
            self.handle.registerTimer(ms + 500)

    pieces = rocks.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in"))
    staff = exports.load_staff(rocks, str(tmp_path / "staff"))
    scored = groups.score(groups.piece_lines(pieces), staff, lambda: datetime.now().replace(microsecond=0), refresh=1, scorer=Soon)
    q = scored.writeStream.outputMode("update").foreachBatch(lambda df, n: ages.extend((r["i1_open_questions"], r["computed_at"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    for _ in range(60):
        if len(ages) > 1:
            break
        q.awaitTermination(1)
    q.stop()
    assert len(ages) > 1 and all(n == 1 for n, _ in ages) and ages[1][1] >= ages[0][1]


def test_helpers_agree_with_the_expressions(spark):
    rnd, cfg = random.Random(6), Vitals()
    words = [*PHRASES, *cfg.negative[:20], *cfg.positive, *cfg.escalation, " ", "好", "嗎", "？", "!", "　", "ok", "收到", " "]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(0, 4))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, i % 7 == 0, i % 11 == 0) for i, t in enumerate(texts)], "i int, text string, is_sticker boolean, is_image boolean")
    for r in enrich(df).collect():
        act, sentiment, escalates = groups.tags(texts[r["i"]], r["is_sticker"] or r["is_image"], cfg)
        assert (r["dialogue_act"], r["is_escalation_marker"]) == (act, escalates) and abs(r["sentiment"] - sentiment) < 1e-12
    rows = [(a, a + rnd.randrange(-10**9, 10**12)) for a in (rnd.randrange(1_700_000_000_000_000, 1_800_000_000_000_000) for _ in range(300))]
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", service_minutes(ts("a"), ts("b")).alias("m")).collect():
        assert groups.service_minutes(r["a"], r["b"], cfg) == r["m"]


class _Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.value, self.map, self.list, self.calls = None, {}, [], 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "get": lambda: iter(self.list) if self.list else self.value, "update": lambda x: setattr(self, "value", x), "appendList": self.list.extend,
            "getValue": lambda k: self.map.get(k), "updateValue": self.map.__setitem__,
        }[name]


def test_state_takes_few_calls_and_keeps_sums_in_blocks():
    """However many lines come, a group's state is read and written by a few calls; a long group's sums are found in their blocks."""
    from pyspark.sql import Row

    def scorer():
        s = groups.Scorer(groups.Vitals(), lambda: datetime(2025, 9, 5, 17))
        s.slim, s.sums, s.reasons, s.escalations = (_Store() for _ in range(4))
        return s

    line = lambda i, piece: Row(piece=piece, line_no=i, valid=True, name="g", is_date=i == 0, is_message=i > 0, day=20336, minute=2 * (i % 700), spoiled=False, sender=f"s{i % 2}", system=False, staff=i % 2 == 0, text=f"我要退款 {i * i}" if i % 300 == 7 else f"text {i} {i * 7919 % 1000}", is_sticker=False, is_image=False)
    whole, cut = scorer(), scorer()
    (want,) = whole.handleInputRows(("g",), iter([line(i, 0) for i in range(1200)]), None)
    bounds, calls = [0, 3, 150, 700, 1199, 1200], []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        before = sum(x.calls for x in (cut.slim, cut.sums, cut.reasons, cut.escalations))
        (got,) = cut.handleInputRows(("g",), iter([line(i, k) for i in range(a, b)][::-1]), None)
        calls.append(sum(x.calls for x in (cut.slim, cut.sums, cut.reasons, cut.escalations)) - before)
    assert got == want and want.i6_points == 1199 and len(want.i6_escalation_fracs) == len(want.reasons) == 4
    assert len(cut.sums.map) == 1198 // groups.BLOCK and max(calls) <= 10
