"""Hard negatives by inner product: length buckets with sorted coordinate lists, feasible ranges of focus coordinates, exact verification.

Components x become floor(scale * x), so scores are integers.  Rows are sorted by length, longest first, over range partitions; a task reads
them in that order and cuts them into buckets of similar length, with one sorted list per coordinate of the unit vectors.  For each
anchor and bucket:

* the score that a row has to reach (the worst of what the anchor holds, or the lower end of its windows) over both lengths is a cosine t; over 1,
  the bucket is left out;
* a unit vector with that cosine has, at a coordinate where the anchor's is c, a value between c t - r and c t + r with
  r = sqrt((1 - c c)(1 - t t)), open to one side if |c| >= t.  At the anchor's focus coordinates, its largest, these ranges are looked up in the
  sorted lists; the shortest list found is intersected with the other ranges;
* what is left is verified by exact integer products.  Where the ranges leave most of a bucket, which they do for low cosines in many
  dimensions, the bucket is verified as one matrix product for all such anchors instead.

Anchors go in blocks of about `block`: a block is broadcast (its size is a parameter), every row meets it where the row is stored, and no vector is
shuffled.  A task keeps the best few rows per anchor or window, so what leaves it does not depend on its rows.  A first pass finds the
positives, a second the negatives inside each positive's window.

Of rows with equal vectors and equal labels only the first few ids can be among the first few results, so the others are not compared: a hot
vector costs no more than any other.

Rows with a null id, a null label, a null or empty vector, or null or non-finite components take no part.  Integer components are held to
the range in which no score leaves 62 bits (at 64 dimensions about 2.7e8).  Vectors of another dimension are another space.  Ties go to the smaller
id.  Repeated ids: a row is never a candidate of its own id, rows of one id are candidates each, and a repeated anchor id is asked once, from the
first of its rows by components, then label.  Windows of negative positives are empty, as 0.8 of one lies above it.  Empty tables give no
rows.  Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, read, shared_dir, written

#: Rows of a bucket at most, and the shortest length in it as a share of its longest.
BUCKET, SIMILAR = 4096, 0.9
#: Focus coordinates of an anchor; share of a bucket beyond which it is verified whole.
FOCUS, WHOLE = 8, 0.25
LOW = np.iinfo(np.int64).min


def usable(df: DataFrame, vec_id: str, label: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, label, v, d, length) of the rows that take part; v: integers."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null and size(x) > 0")
    rows = rows.filter(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size("x")))
    v = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * scale, most.cast("double")), -most.cast("double"))))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("v", v).select("vec_id", "label", "v", F.size("v").alias("d"), length.alias("length"))


def by_length(rows: DataFrame, copies: int) -> DataFrame:
    """Rows sorted by dimension and falling length over range partitions; of equal vectors with equal labels the first `copies` ids."""
    first = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    some = rows.withColumn("n", first).filter(F.col("n") <= copies).drop("n")
    by = [F.asc("d"), F.desc("length"), F.asc("vec_id"), F.asc("label")]
    return written(some.repartitionByRange(*by).sortWithinPartitions(*by), "by-length")


def _unit(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    return v / np.where(length > 0, length, 1)[:, None]


class Bucket:
    """Rows of similar length, longest first, with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, length: np.ndarray):
        self.ids, self.labels, self.v, self.longest = ids, labels, v, float(length.max())
        self.unit = _unit(v, length)
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)
        self.real = v.astype(float)
        self.most = int(np.abs(v).max())


def feasible(c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a unit vector's coordinate whose cosine with one that has c there is t or more (t > 0)."""
    r = np.sqrt(np.maximum(1 - c * c, 0) * np.maximum(1 - t * t, 0))
    return np.where(c <= -t, -1.0, c * t - r) - 1e-9, np.where(c >= t, 1.0, c * t + r) + 1e-9


class Anchors:
    """A block of anchors of one dimension; windows: lower and upper bounds of the scores asked for, several per anchor (lower above upper: none)."""

    def __init__(self, ids, labels, v, lower, upper, same: bool, k: int):
        self.ids, self.labels, self.v, self.lower, self.upper, self.same, self.k = ids, labels, v, lower.copy(), upper, same, k
        self.length = np.sqrt((v.astype(float) ** 2).sum(1))
        self.unit = _unit(v, self.length)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.real, self.most = v.astype(float), int(np.abs(v).max(initial=0))
        none = np.zeros(0, np.int64)
        self.slot, self.score, self.row = none, none, none  # what is held: window, score, id

    def need(self) -> np.ndarray:
        """The least score that is still of use to each anchor; the largest integer if none is."""
        return np.where(self.lower <= self.upper, self.lower, np.iinfo(np.int64).max).min(1)

    def meet(self, bucket: Bucket) -> None:
        need = self.need()
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.nan_to_num(need / (self.length * bucket.longest), nan=0.0, posinf=2.0, neginf=0.0)
        active = np.flatnonzero((t <= 1 + 1e-9) & (self.lower <= self.upper).any(1))
        if not len(active):
            return
        t = np.clip(t[active], 0, 1)
        whole, few = self.chosen(bucket, active, t)
        if len(whole):
            self.whole(bucket, whole, need)
        for a, rows in few:
            if len(rows):
                score = self.products(bucket, np.array([a]), rows)[0]
                fit = score >= need[a]
                self.keep(np.full(fit.sum(), a), score[fit], rows[fit], bucket)

    def chosen(self, bucket: Bucket, active: np.ndarray, t: np.ndarray):
        """Anchors that the bucket is verified whole for, and (anchor, candidates) of the others."""
        n, focus = len(bucket.ids), self.focus[active]
        low, high = feasible(np.take_along_axis(self.unit[active], focus, 1), t[:, None])
        low[t <= 0], high[t <= 0] = -2, 2
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(bucket.lists[:, f], low[at], "left")
            end[at] = np.searchsorted(bucket.lists[:, f], high[at], "right")
        size = end - begin
        pruned = np.prod(size / n, axis=1) < WHOLE
        few = []
        for i in np.flatnonzero(pruned):
            short = int(size[i].argmin())
            rows = bucket.order[begin[i, short] : end[i, short], focus[i, short]]
            for j in np.argsort(size[i], kind="stable")[1:]:
                x = bucket.unit[rows, focus[i, j]]
                rows = rows[(x >= low[i, j]) & (x <= high[i, j])]
            few.append((active[i], rows))
        return active[~pruned], few

    def products(self, bucket: Bucket, anchors: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Exact integer scores: in floating point where every sum is below 2**53."""
        if self.most * bucket.most * self.v.shape[1] < 1 << 53:
            return (self.real[anchors] @ bucket.real[rows].T).astype(np.int64)
        return self.v[anchors] @ bucket.v[rows].T

    def whole(self, bucket: Bucket, anchors: np.ndarray, need: np.ndarray) -> None:
        step = max(1, (1 << 22) // len(bucket.ids))
        for at in range(0, len(anchors), step):
            some = anchors[at : at + step]
            score = self.products(bucket, some)
            allowed = (bucket.labels[None] == self.labels[some, None]) == self.same
            floor = need[some]
            if (floor == LOW).any() and len(bucket.ids) > self.k:  # nothing held yet: the k-th of the bucket is a floor
                best = np.where(allowed & (bucket.ids[None] != self.ids[some, None]), score, LOW)
                floor = np.maximum(floor, np.partition(best, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((score >= floor[:, None]) & allowed)
            self.keep(some[i], score[i, j], j, bucket)

    def keep(self, anchor: np.ndarray, score: np.ndarray, rows: np.ndarray, bucket: Bucket) -> None:
        """Takes in what fits a window; each holds its k largest scores, ties by id."""
        ids = bucket.ids[rows]
        fit = (ids != self.ids[anchor]) & ((bucket.labels[rows] == self.labels[anchor]) == self.same)
        anchor, score, ids = anchor[fit], score[fit], ids[fit]
        if not len(ids):
            return
        slots, scores, found = [self.slot], [self.score], [self.row]
        width = self.lower.shape[1]
        for w in range(width):
            fit = (score >= self.lower[anchor, w]) & (score <= self.upper[anchor, w])
            slots.append(anchor[fit] * width + w)
            scores.append(score[fit])
            found.append(ids[fit])
        slot, score, row = map(np.concatenate, (slots, scores, found))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        self.slot, self.score, self.row = slot[kept], score[kept], row[kept]
        full = place == self.k - 1
        self.lower.reshape(-1)[slot[full]] = np.maximum(self.lower.reshape(-1)[slot[full]], score[full])


def _search(rows: DataFrame, block: dict, same: bool, k: int, out: list[str]) -> DataFrame:
    """(anchor, window, vec_id, score): what each task holds after its rows; block: by dimension, arrays of ids, labels, vectors, lower, upper."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        held = {d: Anchors(*arrays, same, k) for d, arrays in shared.value.items()}

        def close(parts):
            if parts:
                ids, labels, v, length = (np.concatenate(x) for x in zip(*parts))
                held[v.shape[1]].meet(Bucket(ids, labels, v, length))

        parts, size, longest, dimension = [], 0, 0.0, -1
        for batch in batches:
            dims, length = batch.column("d").to_numpy(), batch.column("length").to_numpy()
            ids, labels, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("v")
            at = 0
            while at < len(dims):
                if not parts:
                    longest, dimension = length[at], dims[at]
                fits = (dims[at:] == dimension) & (length[at:] >= SIMILAR * longest) & (length[at:] <= longest)
                run_ = int(fits.argmin()) if not fits.all() else len(fits)
                n = min(run_, BUCKET - size)
                if n and dimension in held:
                    part = slice(at, at + n)
                    parts.append((ids[part], labels[part], v.slice(at, n).flatten().to_numpy().reshape(n, -1), length[part]))
                at, size = at + n, size + n
                if size == BUCKET or n == run_ and at < len(dims):
                    close(parts)
                    parts, size = [], 0
                    if n == 0 and dimension not in held:  # rows of a dimension that no anchor has
                        at += max(run_, 1)
        close(parts)
        for a in held.values():
            width = a.lower.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[a.slot // width]), pa.array(a.slot % width), pa.array(a.row), pa.array(a.score)], out)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in out))


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", block: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that is_anchor (a condition on vec_id) picks: for each
    of an anchor's nearest rows of its label, the nearest rows of other labels whose score is at most the positive's and at least share of it."""
    rows = written(usable(df, vec_id, label, embedding, scale), "vectors")
    sorted_rows = by_length(rows, max(positives, negatives) + 1)
    asked = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label", "d")).alias("x")).select("vec_id", "x.*")
    blocks = max(1, -(-asked.count() // block))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "anchors")
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/hard-negatives-{uuid.uuid4().hex}"
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "row")
    for b in range(blocks):
        some = asked.filter(F.col("block") == b).orderBy("vec_id").collect()  # a block: about `block` rows
        dims = {d: [r for r in some if r.d == d] for d in sorted({r.d for r in some})}
        sides = {d: (np.array([r.vec_id for r in rs]), np.array([r.label for r in rs]), np.array([r.v for r in rs], np.int64)) for d, rs in dims.items()}
        free = {d: (*x, np.full((len(x[0]), 1), LOW), np.full((len(x[0]), 1), -LOW - 1)) for d, x in sides.items()}
        near = _search(sorted_rows, free, True, positives, ["anchor", "window", "row", "score"]).withColumn("n", F.row_number().over(best("anchor")))
        found: dict[int, list] = {}
        for r in near.filter(F.col("n") <= positives).collect():  # a few per anchor of the block
            found.setdefault(r.anchor, []).append((-r.score, r.row))
        windows = {}
        for d, x in sides.items():
            lower, upper = np.zeros((len(x[0]), positives), np.int64), np.full((len(x[0]), positives), -1)
            for i, a in enumerate(x[0].tolist()):
                for w, (score, _) in enumerate(sorted(found.get(a, []))):  # negated scores
                    lower[i, w], upper[i, w] = -(share[0] * score // share[1]), -score
            windows[d] = (*x, lower, upper)
        pairs = [(a, w, row, -score) for a, ps in found.items() for w, (score, row) in enumerate(sorted(ps))]
        chosen = df.sparkSession.createDataFrame(pairs, "anchor long, window long, positive_id long, positive_score long")
        hard = _search(sorted_rows, windows, False, negatives, ["anchor", "window", "row", "score"]).withColumn("n", F.row_number().over(best("anchor", "window"))).filter(F.col("n") <= negatives)
        hard.join(F.broadcast(chosen), ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("n").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/block={b}")
    for table in (rows, asked, sorted_rows):
        drop_written(table)
    return df.sparkSession.read.schema(out).parquet(path).drop("block")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
