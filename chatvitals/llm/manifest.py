"""Merkle manifest of a dataset: a tree of 16 children a node over the rows of each group, and one over the groups' roots.

Checkpoint-and-recompute: of each tree only every second level is stored, as aligned subtrees of up to 256 nodes with the digest of their top.
`proofs` goes down again: it regenerates the missing level between from the stored nodes of each subtree, gives each node the siblings of
both levels before those of its subtree's top, and drops what it made.  So nothing between stored levels is kept, and no task holds more than a
subtree and one path.

1. Leaves are digests of rows (`leaves`), written slim.  They are sorted by range over (group, key, digest), so a group of any size spreads
   over tasks; a row's place in its group is its place in its range and the sizes of the ranges before (`placed`).
2. `store` groups 256 consecutive nodes at a time until each tree has one; levels fall by 256, so a trillion rows take five.
3. The roots of the groups, ordered by group, are the leaves of one more such tree; its top is the root of the manifest.

A leaf is the SHA-256 of its fields, each `-` if null, else its number of UTF-8 bytes, a colon and its text.  A node is the SHA-256 of its
children's hex digests; while several nodes remain, a last run of one is digested too, and a lone leaf is its group's root.

Nulls: a null group is a group, the first; null keys come first in their group.  Ties of a key go by digest, and repeated rows are leaves of
their own.  Empty and very long texts are rows like others: texts are only digested, in the first pass.  Empty tables give no rows and
no root.  Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, drop_written, read, written

WIDTH = 16
SUBTREE = WIDTH * WIDTH
GROUP = ("known", "name")  # whether the group is not null, and its name


def digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields with their lengths."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)), 256)


def leaves(df: DataFrame, fields: dict[str, Column], group: str, key: str, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(known, name, key, digest, changed, salt): a leaf per row; changed: its digest with some fields replaced, where `when` holds."""
    other = F.when(when, digest([(fields | changed)[f] for f in fields])) if changed else F.lit(None).cast("string")
    name = fields[group].cast("string")
    return df.select(name.isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("name"), fields[key].alias("key"), digest(list(fields.values())).alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("salt"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place, from 0 in their group by `order`, and total, the size of the group."""
    by = [*GROUP, *order]
    held = written(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    ranges = held.groupBy(*GROUP, F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*GROUP, "range", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return held.withColumn("range", F.shiftright("at", 33)).join(ranges, [*GROUP, "range"]).select(*GROUP, *(c for c in nodes.columns if c not in GROUP), (F.col("at") + F.col("shift")).alias("place"), "total")


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _above(digests: Column) -> Column:
    """Digests of the runs of an array of up to 256 nodes: the level that is not stored."""
    runs = F.sequence(F.lit(0), ((F.size(digests) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda r: _joined(F.slice(digests, r * WIDTH + 1, F.lit(WIDTH))))


def subtrees(nodes: DataFrame) -> DataFrame:
    """(known, name, subtree, total, nodes, digest): 256 consecutive nodes each, in order, with the digest of their top."""
    held = F.struct("place", *(c for c in nodes.columns if c not in (*GROUP, "place", "total")))
    found = nodes.groupBy(*GROUP, F.shiftright("place", 8).alias("subtree")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(held)).alias("nodes"))
    own = F.col("nodes.digest")
    top = F.when(F.col("total") == 1, own[0]).when(F.col("total") <= WIDTH, _joined(own)).otherwise(_joined(_above(own)))
    return found.withColumn("digest", top)


def store(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels of each group's tree, from (known, name, place, total, digest, ...): leaves first; the last has one subtree a group."""
    stored = [written(subtrees(nodes), "manifest-level")]
    while (stored[-1].agg(F.max("total")).first()[0] or 0) > SUBTREE:
        above = stored[-1].select(*GROUP, F.col("subtree").alias("place"), F.ceil(F.col("total") / SUBTREE).alias("total"), "digest")
        stored.append(written(subtrees(above), "manifest-level"))
    return stored


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots; root: null without rows."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """From what `leaves` gives."""
    rows = written(rows, "manifest-leaves")
    nodes = placed(rows, ["key", "digest", "salt"])
    levels = store(nodes.drop("salt"))
    roots = levels[-1].select(F.lit(True).alias("known"), F.lit("").alias("name"), F.struct(*GROUP).alias("group"), "digest")
    tops = store(placed(roots, ["group"]))
    drop_written(rows)
    top = tops[-1].select("digest").first()
    return Manifest(levels, tops, top and top.digest)


def _beside(digests: Column, i: Column) -> Column:
    """The digests before and after node i in its run, as texts."""
    at = i % WIDTH
    first = i - at + 1
    text = lambda start, n: F.array_join(F.slice(digests, start, n), "")
    return F.struct(text(first, at).alias("before"), text(first + at + 1, F.lit(WIDTH - 1) - at).alias("after"))


def _down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level with `path`, from (known, name, subtree, path, ...) of what stands above each group's tree."""
    kept = [c for c in above.columns if c not in (*GROUP, "subtree", "path")]
    for level in reversed(levels):
        met = level.select(*GROUP, "subtree", "total", "nodes").join(above, [*GROUP, "subtree"])
        own, total = F.col("nodes.digest"), F.col("total")
        met = met.withColumn("between", F.when(total > WIDTH, _above(own)))

        def path(i: Column) -> Column:
            here = F.when(total > 1, F.array(_beside(own, i))).otherwise(F.filter(F.array(_beside(own, i)), lambda _: F.lit(False)))
            there = F.when(total > WIDTH, F.array(_beside(F.col("between"), (i / WIDTH).cast("int")))).otherwise(F.slice(here, 1, 0))
            return F.concat(here, there, F.col("path"))

        found = met.select(*GROUP, *kept, F.explode(F.transform("nodes", lambda x, i: F.struct(x.alias("node"), path(i).alias("path")))).alias("x"))
        above = found.select(*GROUP, *kept, "x.node.*", "x.path").withColumn("subtree", F.col("place"))
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """(known, name, key, digest, changed, place, subroot, path) of every leaf; path: from the leaf's run to the root's, the text of the
    siblings' digests before and after it."""
    start = manifest.tops[-1].select(*GROUP, "subtree", F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    groups = _down(manifest.tops, start).select("group.*", F.lit(0).cast("long").alias("subtree"), F.col("digest").alias("subroot"), "path")
    return _down(manifest.levels, groups).drop("subtree")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


#: The fields of a leaf of `documents`, in order (fixed).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = build(leaves(docs, {f: F.col(f) for f in FIELDS}, "source", "doc_id", {"text": lower}, crc_mod("doc_id", 5) == 0))
    root = F.lit(made.root).cast("string")
    found = proofs(made).withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
