"""N-gram Jaccard join with signature trees, and the groups that its links connect.

A document's set holds the hashes of its distinct word n-grams; two link when den * intersection >= num * union.
Equal sets are one node.  Linked sets of size n share one at least of the first n - ceil(n * num / den) + 1 elements of any common
order (n-grams that are frequent in a bounded sample come last in ours, which only saves work), so nodes meet at
those elements, their keys.  Keys that one node has alone are dropped.  Then:

1. A signature tree over the bitmaps of the nodes at a key (leaves and inner nodes hold OR-combined bitmaps and size ranges) is
   traversed against itself; node pairs are pruned by their largest possible overlap, and where union-find has
   connected all already.  Pairs that may link connect their nodes to a cluster.  First every node at one key,
   then all keys where more than one cluster still meets; clusters come out as stars, so output is no larger than input.
2. Each cluster's texts meet once.  A tree over finer bitmaps gives the pairs, exact overlaps decide, and union-find again
   leaves out what is connected: groups of copies take nearly as many comparisons as nodes.
3. Components come from the stars by label propagation with shortcuts, in tables.

A key or cluster with more nodes than `crowd` is dealt in blocks, each pair of blocks a task: no group is gathered whole.

Words are runs of bytes other than space and \\t to \\r, A-Z lower-cased; fewer than n words are one n-gram, no words an
empty set that links with nothing.  Null text counts as empty.  Null ids keep their rows (component: null if
alone or smallest among ids that are not null).  Rows that repeat an id are separate documents.  Empty tables give no rows.  Other columns
are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, MIX2, drop_written, mix, near_rows, prefix_hash, range_hash, text_blocks, trim, words, written

LEAF, FAN = 16, 8


def shingle_sets(column, n: int):
    """For runs of rows: first row, sorted distinct hashes (signed) of all rows one after another, and their bounds."""
    for first, blob, bounds in text_blocks(column, 1 << 20):
        rows = len(bounds) - 1
        if len(blob):
            low, start, end = words(blob, bounds)
            hashes = range_hash(prefix_hash(low), start, end)
        else:
            start, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row = np.searchsorted(bounds[1:], start, "right")
        count = np.bincount(row, minlength=rows)
        whole = hashes
        grams = np.zeros(max(0, len(whole) - n + 1), np.uint64)
        for k in range(n):
            grams = grams * BASE + whole[k : k + len(grams)]
        inside = row[: len(grams)] == row[n - 1 : n - 1 + len(grams)]
        grams, of = mix(grams[inside]), row[: len(grams)][inside]
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            at = np.cumsum(count) - count
            short = np.zeros(len(few), np.uint64)
            for k in range(n - 1):
                more = count[few] > k
                short[more] = short[more] * BASE + whole[at[few][more] + k]
            grams = np.concatenate([grams, mix(short + count[few].astype(np.uint64) * MIX2)])
            of = np.concatenate([of, few])
        values = grams.view(np.int64)
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[new], of[new]
        yield first, values, np.searchsorted(of, np.arange(rows + 1))


def bitmap(values: np.ndarray, per: int = 1) -> np.ndarray:
    """A set's bitmap, as long as the power of two from `per` times its size on."""
    m = max(64, 1 << int(per * len(values) - 1).bit_length())
    flags = np.zeros(m, bool)
    flags[values & (m - 1)] = True
    return np.packbits(flags)


def own_sets(column, n: int) -> list[np.ndarray]:
    """The set of each text."""
    return [values[bounds[i] : bounds[i + 1]] for _, values, bounds in shingle_sets(column, n) for i in range(len(bounds) - 1)]


def node_id(values: np.ndarray) -> int:
    """A set's name: a hash of its elements, whatever their order; 0 for the empty set."""
    if not len(values):
        return 0
    u = values.view(np.uint64)
    both = u.sum(keepdims=True) * BASE ^ np.bitwise_xor.reduce(u, keepdims=True) + np.uint64(len(u))
    return int(mix(both).view(np.int64)[0])


class Links:
    """Union-find over the nodes of a task."""

    def __init__(self, labels):
        seen: dict = {}
        self.up = [seen.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


class SignatureTree:
    """Nodes over sets sorted by size: OR-combined bitmaps, smallest and largest size, and the most elements that share bits in one set."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, num: int, den: int, links: Links, names: np.ndarray):
        self.maps, self.sizes, self.num, self.den, self.links, self.names = maps, sizes, num, den, links, names
        slack = sizes - _count(maps)
        self.levels = []
        starts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), np.maximum.reduceat(slack, starts))
        self.levels.append(level)
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FAN)
            level = tuple(f.reduceat(x, starts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level))
            self.levels.append(level)

    def _rows(self, level: int, node: int) -> range:
        width = LEAF * FAN**level
        return range(node * width, min(len(self.sizes), (node + 1) * width))

    def pairs(self):
        """(i, j) rows whose bitmaps allow a link, where union-find has not connected them yet."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            maps, low, high, slack = self.levels[level]
            if high[a] * self.den < low[b] * self.num or high[b] * self.den < low[a] * self.num:
                continue
            need = self.num * (low[a] + low[b])
            if (self.num + self.den) * (_count(maps[a] & maps[b]) + min(slack[a], slack[b])) < need:
                continue
            roots = {self.links.root(self.names[i]) for x in ((a,) if a == b else (a, b)) for i in self._rows(level, x)}
            if len(roots) == 1:
                continue
            if level:
                x, y = (range(k * FAN, min(len(self.levels[level - 1][1]), (k + 1) * FAN)) for k in (a, b))
                stack += [(level - 1, i, j) for i in x for j in y if i <= j]
                continue
            left, right = np.array(self._rows(0, a)), np.array(self._rows(0, b))
            only = _count(self.maps[left][:, None] & ~self.maps[right][None])
            other = _count(self.maps[right][None] & ~self.maps[left][:, None])
            most = np.minimum(self.sizes[left][:, None] - only, self.sizes[right][None] - other)
            fits = (self.num + self.den) * most >= self.num * (self.sizes[left][:, None] + self.sizes[right][None])
            for i, j in zip(*np.nonzero(fits)):
                if left[i] < right[j] and self.links.root(self.names[left[i]]) != self.links.root(self.names[right[j]]):
                    yield int(left[i]), int(right[j])


def meetings(maps: list[np.ndarray], sizes: np.ndarray, num: int, den: int, links: Links):
    """Pairs from one signature tree for each bitmap length; sets of the next length join in folded."""
    order = np.argsort(sizes, kind="stable")
    lengths = np.array([len(maps[i]) for i in order])
    for m in np.unique(lengths):
        rows = [int(i) for i in order[lengths == m]] + [int(i) for i in order[lengths == 2 * m]]
        if len(rows) < 2:
            continue
        table = np.stack([maps[i] if len(maps[i]) == m else maps[i][:m] | maps[i][m:] for i in rows])
        for i, j in SignatureTree(table, sizes[rows], num, den, links, np.array(rows)).pairs():
            if len(maps[rows[i]]) == m or len(maps[rows[j]]) == m:
                yield rows[i], rows[j]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both) and both > 0


def _tables(batches, keys: list[str]):
    """Arrow tables of the rows of one group each; rows come sorted by keys."""
    waiting, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            key = tuple(c[low] for c in columns)
            if waiting and key != at:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            at = key
            waiting.append(batch.slice(low, high - low))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _dealt(rows: DataFrame, crowd: int) -> DataFrame:
    """rows (key, node, meet: how many share the key) with the block pair (s, t) of each task; small keys have one block."""
    blocks = F.ceil(F.col("meet") / crowd).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("s", F.least("mine", "other")).withColumn("t", F.greatest("mine", "other")).drop("mine", "other").repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "node")


def stars(links: Links, nodes: np.ndarray) -> pa.RecordBatch:
    """Each connected part as links to its smallest node."""
    roots = np.array([links.root(i) for i in range(len(nodes))])
    center = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(center, roots, nodes)
    apart = center[roots] != nodes
    return pa.RecordBatch.from_arrays([pa.array(center[roots][apart]), pa.array(nodes[apart])], schema=_LINKS)


LINKS = "a long, b long"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for every node of a link."""
    edges = written(links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "seen"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        better = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = written(better.join(above, "label", "left").select("node", "old", F.least("label", "higher").alias("label")), "labels")
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def row_key(doc_id: str, text: str):
    """A hash of id and text: rows that share it are copies in both."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


class Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, sample: int = 5_000, crowd: int = 2048):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_key(doc_id, text).alias("row"))
        self.n, self.num, self.den, self.sample, self.crowd = n, num, den, sample, crowd

    def frequent(self) -> np.ndarray:
        """N-grams in at least 1 of 1000 rows of a sample of about `sample` rows (picked by a hash): bounded by the sample's size."""
        n, total = self.n, self.docs.count()
        picked = self.docs if total <= self.sample else self.docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < (self.sample << 30) // total)

        def run(batches):
            for batch in batches:
                for _, values, _ in shingle_sets(batch.column("text"), n):
                    keys, count = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], ["key", "c"])

        least = max(5, min(total, self.sample) // 1000)
        found = picked.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
        return np.sort(found.select("key").toPandas()["key"].to_numpy(np.int64))

    def sets(self, last: np.ndarray) -> DataFrame:
        """doc_id, row key, node, size, keys and bitmap of every document; last: n-grams that come last in the order of keys."""
        n, num, den = self.n, self.num, self.den

        def run(batches):
            for batch in batches:
                ids, marks = batch.column("doc_id"), batch.column("row")
                for first, values, bounds in shingle_sets(batch.column("text"), n):
                    rows, keys, maps, names = len(bounds) - 1, [], [], []
                    late = np.isin(values, last)
                    for i in range(rows):
                        v, l = values[bounds[i] : bounds[i + 1]], late[bounds[i] : bounds[i + 1]]
                        size = len(v) - -(-len(v) * num // den) + 1 if len(v) else 0
                        rare = v[~l][:size]
                        keys.append(rare if len(rare) == size else np.concatenate([rare, v[l][: size - len(rare)]]))
                        maps.append(bitmap(v).tobytes())
                        names.append(node_id(v))
                    offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                    yield pa.RecordBatch.from_arrays([ids.slice(first, rows), marks.slice(first, rows), pa.array(names, pa.int64()), pa.array(np.diff(bounds)), lists, pa.array(maps, pa.large_binary())], ["doc_id", "row", "node", "size", "keys", "map"])
            trim()

        return self.docs.mapInArrow(run, "doc_id long, row long, node long, size long, keys array<long>, map binary")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """wanted (with row) and the text of each: only documents that may be among them are shuffled, and of equal rows one."""
        return near_rows(self.docs.select("row", "text"), wanted, "row").groupBy("row").agg(F.first("text").alias("text")).join(wanted, "row")

    def run(self, labels_too: bool = False) -> DataFrame:
        """doc_id, n_shingles, component_id for every row; with row keys and labels (components by name, 0 of those without words) if asked."""
        table = written(self.sets(self.frequent()), "sets")
        slim = written(table.select("doc_id", "row", "node", "size"), "slim")
        nodes = written(table.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.max("size").alias("size"), F.min(F.struct("keys", "map")).alias("x")).select("node", "doc_id", "row", "size", "x.keys", "x.map"), "nodes")
        drop_written(table)
        keys = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key"))
        shared = keys.withColumn("meet", F.count("*").over(Window.partitionBy("key"))).filter("meet > 1")
        shared = written(shared, "shared")
        maps = nodes.select("node", "map")
        home = self._apart(shared.groupBy("node", "size").agg(F.min("pos").alias("pos"), F.min_by("key", "pos").alias("key")), None)
        stars = written(self.candidates(home.join(maps, "node")), "stars")
        labels = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        rest = self._apart(shared.select("node", "size", "pos", "key"), labels)
        more = written(self.candidates(rest.join(maps, "node")), "stars")
        clusters = components(stars.unionByName(more))
        met = clusters.withColumn("meet", F.count("*").over(Window.partitionBy("label"))).withColumnRenamed("label", "key").join(nodes.select("node", "row"), "node")
        labels = components(self.connected(self.texts(met)))
        # a label is a node; its documents' smallest id names the component
        of = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        names = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = of.join(names, "label").select("node", "label", "component_id")
        found = slim.filter("size > 0").withColumnRenamed("size", "n_shingles").join(named, "node")
        rest = slim.filter("size = 0").withColumnRenamed("size", "n_shingles").withColumn("label", F.lit(0).cast("long")).withColumn("component_id", F.col("doc_id"))
        columns = ["doc_id", "n_shingles", "component_id", *(["row", "label"] if labels_too else [])]
        return found.select(*columns).unionByName(rest.select(*columns))

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Stars (a, b) of nodes that may link, or are tied by nodes that may; rows: key, node, label, size, pos, map, meet."""
        num, den = self.num, self.den

        def run(batches):
            for batch in _small(batches, num, den):
                for t in _tables([batch], ["key", "s", "t"]):
                    sizes, pos = t.column("size").to_numpy(), t.column("pos").to_numpy()
                    maps = [np.frombuffer(x.as_py(), np.uint8) for x in t.column("map").chunk(0)]
                    links = Links(t.column("label").to_numpy().tolist())
                    new = False
                    for i, j in meetings(maps, sizes, num, den, links):
                        # what stands before the key in both, the key, and what stands behind it in both
                        if (num + den) * (min(pos[i], pos[j]) + min(sizes[i] - pos[i], sizes[j] - pos[j])) >= num * (sizes[i] + sizes[j]):
                            new |= links.join(i, j)
                    if new:
                        yield stars(links, t.column("node").to_numpy())
            trim()

        return _dealt(rows, self.crowd).select("key", "s", "t", "node", "label", "size", "pos", "map").mapInArrow(run, LINKS)

    def connected(self, rows: DataFrame) -> DataFrame:
        """Stars (a, b) of nodes that links connect; rows: key (the cluster), node, text, meet."""
        n, num, den = self.n, self.num, self.den

        def run(batches):
            for t in _tables(batches, ["key", "s", "t"]):
                nodes, sets = t.column("node").to_numpy(), own_sets(t.column("text"), n)
                mine = [node_id(v) == x for v, x in zip(sets, nodes.tolist())]  # row keys are hashes
                nodes, sets = nodes[np.array(mine, bool)], [v for v, m in zip(sets, mine) if m]
                links = Links(nodes.tolist())
                new = False
                for i, j in meetings([bitmap(v, 8) for v in sets], np.array([len(v) for v in sets]), num, den, links):
                    if linked(sets[i], sets[j], num, den):
                        new |= links.join(i, j)
                if new:
                    yield stars(links, nodes)
            trim()

        return _dealt(rows, self.crowd).select("key", "s", "t", "node", "text").mapInArrow(run, LINKS)

    def _apart(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """rows (node, key) with their labels and counts, at keys where several labels meet."""
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else rows.withColumn("label", F.col("node"))
        w = Window.partitionBy("key")
        # a set without any other of a fitting size at its key has no partner there
        by_size, size = w.orderBy("size"), F.col("size")
        fits = (F.lag("size").over(by_size) * self.den >= size * self.num) | (F.lead("size").over(by_size) * self.num <= size * self.den)
        rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False))).filter("_fits").drop("_fits")
        return rows.withColumn("low", F.min("label").over(w)).withColumn("high", F.max("label").over(w)).withColumn("meet", F.count("*").over(w)).filter("low <> high").drop("low", "high")


def _small(batches, num: int, den: int):
    """Tables with the rows of whole keys; keys of two nodes that sizes or places already rule out are left out, all at once."""
    for t in _runs(batches):
        key = t.column("key").to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        two = starts[length == 2]
        size, pos = t.column("size").to_numpy(), t.column("pos").to_numpy()
        a, b = size[two], size[two + 1]
        most = np.minimum(pos[two], pos[two + 1]) + np.minimum(a - pos[two], b - pos[two + 1])
        out = two[(num + den) * most < num * (a + b)]
        keep = np.ones(len(key), bool)
        keep[out] = keep[out + 1] = False
        if keep.any():
            yield t.filter(pa.array(keep)).combine_chunks().to_batches()[0]


def _runs(batches):
    """The same rows in tables that end with a key's last row."""
    waiting = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        changes = np.flatnonzero(key[1:] != key[:-1])
        if waiting and waiting[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        if len(changes):  # up to where the last key begins
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks()
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text", labels_too: bool = False, **more) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) for every row of docs; links: similarity of num / den or more on n words.
    labels_too adds row (row_key) and label, which tells components without an id apart."""
    return Join(docs, n, num, den, doc_id, text, **more).run(labels_too)


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return groups(read(spark, sf_dir, "documents"), 4, 85, 100)
