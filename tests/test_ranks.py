"""Ranks from splitters, with ties, and after cached blocks are gone."""

import random

from pyspark.sql import functions as F

from chatvitals import held
from chatvitals.plans import analysis


def test_ranks_survive_lost_blocks(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)  # cached, not checkpointed
    rnd = random.Random(12)
    rows = [(i, rnd.random() < 0.1, rnd.choice([0.0, 0.0, 0.0, 0.25, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "group_key int, tripwire boolean, composite double").repartition(7)
    with held.scope():
        ranked = analysis.ranked(df)
        want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (not r[1], -r[2], r[0])))}
        half = {r["group_key"]: r["rank"] for r in ranked.filter(F.col("group_key") % 2 == 0).collect()}
        spark.catalog.clearCache()  # the parts that are read next are computed again
        half |= {r["group_key"]: r["rank"] for r in ranked.filter(F.col("group_key") % 2 == 1).collect()}
    assert half == want
    assert analysis.ranked(df.limit(0)).count() == 0 and [r["rank"] for r in analysis.ranked(df.limit(1)).collect()] == [1]


def test_scope_lets_go(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    with held.scope():
        df = held.once(spark.range(10))
        assert df.is_cached and held.once(df) is df
    assert not df.is_cached
