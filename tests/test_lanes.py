"""Giant groups in lanes: the same results as without, wherever the cuts are."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatvitals.config import Vitals
from chatvitals.operators import lanes
from chatvitals.operators.merge import merge_fragments

T0 = datetime(2025, 9, 1)
RAW = "group_key int, seq long, sender string, ts timestamp_ntz, text string, is_sticker boolean, is_image boolean"


def burst(seed, n, steps, other=0.0, special=0.0, group=1):
    rnd, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += rnd.choice(steps)
        rows.append((group, seq, "b" if rnd.random() < other else "a", T0 + timedelta(seconds=at), f"t{seq}", rnd.random() < special, False))
    return rows


def merged(rows, limit=60):
    out, last = [], None
    for g, seq, sender, ts, text, special, _ in rows:
        if last and g == last[0] and not special and not last[3] and sender == last[1] and (ts - last[2]).total_seconds() <= limit:
            out[-1] = (*out[-1][:2], f"{out[-1][2]} {text}")
        else:
            out.append((g, seq, text))
            last = (g, sender, ts, special)
        last = (g, sender, last[2], special)
    return out


@pytest.mark.parametrize(
    "rows",
    [
        burst(1, 400, [20]),
        burst(2, 400, [0, 1, 5, 20, 59, 61, 200, -30], 0.03, 0.02),
        burst(3, 300, [1]) + burst(4, 5, [10], group=2),
        burst(5, 300, [0]),
        burst(6, 300, [-70, 0, 20, 65, 3], 0.01),
        burst(7, 200, [30, 31], 0.0, 0.01) + burst(8, 200, [7, -3], 0.02, group=2) + burst(9, 1, [1], group=3),
        burst(10, 300, [-1]),
    ],
    ids=["chain", "mixed", "dense", "one time", "back and forth", "two groups", "falling"],
)
@pytest.mark.parametrize("size", [40])
def test_merge_in_lanes(spark, rows, size):
    df = lanes.assign(spark.createDataFrame(rows, RAW).repartition(3), size)
    assert lanes.LANE in df.columns
    got = merge_fragments(df)
    assert sorted((r["group_key"], r["seq"], r["text"]) for r in got.collect()) == merged(rows)
    by_seq = {(r[0], r[1]): r for r in rows}
    assert all(by_seq[r["group_key"], r["seq"]][2:4] == (r["sender"], r["ts"]) for r in got.collect())


def test_lanes_are_even(spark):
    df = spark.range(20_000).select(F.lit(1).alias("group_key"), "id", (F.col("id") * F.col("id")).alias("seq")).unionByName(spark.range(500).select((F.col("id") % 50 + 2).cast("int").alias("group_key"), "id", F.col("id").alias("seq")))
    sizes = [r["count"] for r in lanes.assign(df, 1000).filter("group_key = 1").groupBy(lanes.LANE).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1200 and lanes.assign(df, 1000).filter("group_key > 1").agg(F.max(lanes.LANE)).first()[0] == 0
    assert lanes.LANE not in lanes.assign(df, 30_000).columns


@pytest.mark.parametrize("backwards", [False, True])
def test_running(spark, backwards):
    rnd = random.Random(11)
    rows, island = [], 0
    for seq in range(500):
        island += rnd.random() < 0.02
        rows.append((1 if seq < 450 else 2, seq, island, rnd.choice([None, 1, 2, 3, 9]), rnd.randrange(100)))
    df = lanes.assign(spark.createDataFrame(rows, "group_key int, seq long, island long, v int, x int").repartition(3), 40)
    scans = {"total": lanes.Scan("sum", F.col("x")), "most": lanes.Scan("max", F.col("x")), "seen": lanes.Scan("last", F.col("v"))}
    for within in (None, "island"):
        got = {r["seq"]: (r["total"], r["most"], r["seen"]) for r in lanes.running(df, scans, within=within, backwards=backwards).collect()}
        for g, seq, i, _, _ in rows:
            before = [r for r in rows if r[0] == g and (within is None or r[2] == i) and (r[1] > seq if backwards else r[1] < seq)]
            before = before[::-1] if backwards else before
            want = sum(r[4] for r in before), max((r[4] for r in before), default=None), next((r[3] for r in reversed(before) if r[3] is not None), None)
            assert got[seq] == want
