"""Order-dependent steps of giant groups, spread over tasks.

A group of more than a given number of rows is cut into lanes: stretches of its order, between splitters that are approximate quantiles of the
order column.  Windows then run inside (group, lane), and `running` carries over what the lanes before have in sum: one summary per lane, combined
in the lanes' order, joined back to the lanes' rows.  Results do not depend on where the cuts are.

Only giant groups have lanes beyond the first, so splitters and summaries number at most twice all rows over the rows of a lane; they are
broadcast.  A frame without the column LANE has no giant groups: the same functions are plain windows there."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..held import once

LANE = "_lane"
#: Lanes of a group at most.
SPLITS = 256


def assign(df: DataFrame, rows: int, key: str = "group_key", order: str = "seq") -> DataFrame:
    """df with LANE if a group has more than `rows` rows, else df as it is."""
    if LANE in df.columns:
        return df
    giant = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    giant = once(giant)
    if giant.isEmpty():
        return df
    quantiles = F.percentile_approx(order, [i / SPLITS for i in range(1, SPLITS)], 100_000)
    found = df.select(key, order).join(F.broadcast(giant), key).groupBy(key).agg(quantiles.alias("_q"), F.least(F.lit(SPLITS), F.ceil(F.max("_n") / rows)).cast("int").alias("_k"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda j: F.get(F.col("_q"), F.floor(j * SPLITS / F.col("_k")).cast("int") - 1))
    found = once(found.select(key, F.array_distinct(cuts).alias("_cuts")))
    lane = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    return df.join(F.broadcast(found), key, "left").select(*df.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(lane).alias(LANE))


def by(df: DataFrame, key: str = "group_key") -> list[str]:
    """Columns that bound a window: the group, and its lanes if there are giant groups."""
    return [key, LANE] if LANE in df.columns else [key]


class Scan(NamedTuple):
    """What is carried along: the "sum" or "max" of a value, or its "last" that is not null."""

    kind: str
    value: Column


def _over(scan: Scan, w) -> Column:
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(w)
    return F.coalesce(F.sum(scan.value).over(w), F.lit(0)) if scan.kind == "sum" else F.max(scan.value).over(w)


def _combined(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, earlier)
    return F.coalesce(earlier, F.lit(0)) + here if kind == "sum" else F.greatest(earlier, here)


def running(df: DataFrame, scans: dict[str, Scan], key: str = "group_key", order: str = "seq", within: str | None = None, backwards: bool = False) -> DataFrame:
    """Adds a column for each scan over the rows before (backwards: after) each row of its group, or of its `within`, which has to be the same along
    stretches of the order."""
    extra = [within] if within else []
    columns, to = [*by(df, key), *extra], F.desc if backwards else F.asc
    upto = Window.partitionBy(*columns).orderBy(to(order)).rowsBetween(Window.unboundedPreceding, -1)
    if LANE not in df.columns:
        return df.withColumns({n: _over(s, upto) for n, s in scans.items()})
    df = once(df)
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: (F.min_by if backwards else F.max_by)(v, F.when(v.isNotNull(), F.col(order)))}
    ends = df.groupBy(*columns).agg(*(whole[s.kind](s.value).alias(n) for n, s in scans.items()))
    if within:  # only what stands at an end of a lane goes on
        lane, x = Window.partitionBy(*by(df, key)), F.col(within)
        ends = ends.withColumn("_edge_of_lane", (x == F.min(x).over(lane)) | (x == F.max(x).over(lane))).filter("_edge_of_lane").drop("_edge_of_lane")
    earlier = Window.partitionBy(key, *extra).orderBy(to(LANE)).rowsBetween(Window.unboundedPreceding, -1)
    named = {n: f"_carried_{i}" for i, n in enumerate(scans)}
    carried = ends.select(*columns, F.count("*").over(earlier).alias("_before"), *(_over(Scan(s.kind, F.col(n)), earlier).alias(named[n]) for n, s in scans.items())).filter("_before > 0").drop("_before")
    here = df.withColumns({n: _over(s, upto) for n, s in scans.items()})
    met = here.join(F.broadcast(carried), columns, "left")
    return met.select(*df.columns, *(_combined(s.kind, F.col(named[n]), F.col(n)).alias(n) for n, s in scans.items()))
