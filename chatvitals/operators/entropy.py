"""Character bigrams and their entropy, per text and along a conversation."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Vitals
from ..functions.text import bigrams, long_text_bits
from .lanes import LANE, Scan, running


def bigram_counts(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, bigram, n)"""
    return texts.select(*keys, F.explode(bigrams(F.col("text"))).alias("bigram")).groupBy(*keys, "bigram").agg(F.count("*").alias("n"))


def bits(n: str = "n") -> Column:
    """Shannon entropy of counts, as an aggregate."""
    c = F.col(n).cast("double")
    return F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c) + F.lit(0.0)


def bigram_entropy(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, entropy) of all texts of each key; keys without bigrams have none here (0 by definition)."""
    return bigram_counts(texts, *keys).groupBy(*keys).agg(F.greatest(F.lit(0.0), bits()).alias("entropy"))


def text_entropy(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, entropy) of each text: counted inside its row, so nothing is exploded or shuffled; texts without bigrams have none here."""
    return texts.filter(F.length("text") >= 2).select(*keys, long_text_bits(F.col("text")).alias("entropy"))


def text_messages(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """Messages with text, their position and how many there are."""
    found = messages.filter((F.col("text") != "") & ~F.col("is_sticker"))
    found = running(found, {"pos": Scan("sum", F.lit(1).cast("long"))}, key).withColumn("pos", F.col("pos").cast("int"))
    if LANE not in messages.columns:
        return found.withColumn("n_text", F.count("*").over(Window.partitionBy(key)).cast("int"))
    return found.join(found.groupBy(key).agg(F.count("*").cast("int").alias("n_text")), key)


class Multiset:
    """Bigrams of the last few texts: counts go up and down as texts come and go, and how many bigrams have each count, which is all that entropy asks."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.having: dict[int, int] = {}
        self.total = 0

    @staticmethod
    def of(text: str) -> list[tuple[int, int]]:
        """Bigrams of code points as numbers, with their counts."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        pairs, n = np.unique(points[:-1] << np.uint64(32) | points[1:], return_counts=True)
        return list(zip(pairs.tolist(), n.tolist()))

    def move(self, bigrams: list[tuple[int, int]], sign: int) -> None:
        counts, having = self.counts, self.having
        for pair, n in bigrams:
            old = counts.get(pair, 0)
            new = old + sign * n
            if old:
                having[old] -= 1
                if not having[old]:
                    del having[old]
            if new:
                counts[pair] = new
                having[new] = having.get(new, 0) + 1
            else:
                del counts[pair]
            self.total += sign * n

    def bits(self) -> float:
        """Shannon entropy; 0 without bigrams.  Summed from the counts each time, so nothing drifts."""
        if not self.total:
            return 0.0
        return max(0.0, math.log2(self.total) - sum(m * n * math.log2(n) for n, m in sorted(self.having.items())) / self.total)


def _sliding(keys: list[str], window: int, out: list[str]):
    """Entropy of the last `window` texts of sorted rows."""

    def run(batches):
        at, held, last = None, Multiset(), deque()
        for batch in batches:
            bits = []
            for *key, text in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("text").to_pylist()):
                if key != at:
                    at, held, last = key, Multiset(), deque()
                if len(last) == window:
                    held.move(last.popleft(), -1)
                last.append(Multiset.of(text))
                held.move(last[-1], 1)
                bits.append(held.bits())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(bits, pa.float64())], schema=pa.schema([*(batch.schema.field(c) for c in out), pa.field("entropy", pa.float64())]))

    return run


def entropy_series(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(group, pos, ts, entropy) over the last few text messages; groups with less than two have none.

    A sorted pass with a sliding multiset: each bigram comes and goes once, however long the window.  Giant groups are dealt out by position, in
    stretches that begin with the last few messages of the stretch before."""
    texts = text_messages(messages, key).filter("n_text >= 2")
    cut, first = [key], F.lit(True)
    if LANE in messages.columns:
        stretch = F.floor(F.col("pos") / cfg.lane_rows).cast("int")
        ahead = F.col("pos") % cfg.lane_rows >= cfg.lane_rows - (cfg.entropy_window - 1)
        texts = texts.withColumn("_own", stretch).withColumn("_stretch", F.explode(F.when(ahead, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
        cut, first = [key, "_stretch"], F.col("_own") == F.col("_stretch")
    out = [key, "pos", "ts", "n_text", *(["_own", "_stretch"] if len(cut) > 1 else [])]
    rows = texts.select(*out, "text").repartition(*cut).sortWithinPartitions(*cut, "pos")
    kinds = T.StructType([*(rows.schema[c] for c in out), T.StructField("entropy", T.DoubleType())])
    return rows.mapInArrow(_sliding(cut, cfg.entropy_window, out), kinds).filter(first).select(key, "pos", "ts", "n_text", "entropy")


def chart_stats(series: DataFrame, key: str = "group_key") -> DataFrame:
    """Lowest, highest and mean entropy of a series, and the range that a chart of it spans."""
    e = F.col("entropy")
    return series.groupBy(key).agg(F.min(e).alias("e_min"), F.max(e).alias("e_max"), F.avg(e).alias("e_mean"), F.greatest(F.max(e) - F.min(e), F.lit(0.5)).alias("e_range"))


def i6(series: DataFrame, key: str = "group_key") -> DataFrame:
    """Mean, slope (late half less early half) and place of the first peak."""
    half = F.floor(F.col("n_text") / 2)
    late, early = F.avg(F.when(F.col("pos") >= half, F.col("entropy"))), F.avg(F.when(F.col("pos") < half, F.col("entropy")))
    peak = F.max_by(F.col("pos"), F.struct(F.round("entropy", 9), -F.col("pos")))
    return series.groupBy(key).agg(
        F.avg("entropy").alias("i6_mean_entropy"),
        (late - early).alias("i6_entropy_slope"),
        (peak / (F.max("n_text") - 1)).alias("i6_peak_entropy_frac"),
        F.max("n_text").alias("i6_points"),
    )


def escalation_fracs(messages: DataFrame, key: str = "group_key") -> DataFrame:
    """(group, pos, frac) of escalating text messages where there is more than one text message."""
    return text_messages(messages, key).filter("is_escalation_marker and n_text > 1").select(key, "pos", (F.col("pos") / (F.col("n_text") - 1)).alias("frac"))


def chart_points(series: DataFrame, key: str = "group_key") -> DataFrame:
    """(group, pos, x, y) of series that can be drawn: x along the conversation, y within the range (half a bit at least)."""
    w = Window.partitionBy(key)
    low, high = F.min("entropy").over(w), F.max("entropy").over(w)
    return series.withColumn("_low", low).withColumn("_range", F.greatest(high - low, F.lit(0.5))).select(key, "pos", (F.col("pos") / (F.col("n_text") - 1)).alias("x"), ((F.col("entropy") - F.col("_low")) / F.col("_range")).alias("y"))
