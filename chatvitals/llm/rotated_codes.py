"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length, padded with zeros to `bits` dimensions and turned by a random rotation; a code keeps the sign of each
coordinate in one bit, with two correction scalars: the vector's length, and s, the inner product of the turned unit vector with its
own code.  The code's inner product with a turned query, divided by s, estimates the true one without bias; the error's
deviation is sqrt((1 - s*s) / (s*s * (bits - 1))) of the lengths at most, and the bound is `sureness` deviations.

1. Every row is indexed (nothing is fitted): packed codes and scalars, written once.
2. Blocks of codes meet blocks of queries; each gives some rows of largest estimate per query.  Of the exact inner products of
   the 4 k best of those, the k-th is a floor: the k-th nearest has no smaller one.
3. Blocks meet again, and only rows whose upper bound reaches their query's floor come out (`reranked` of them).  Their
   vectors are fetched by row, the exact inner product in double precision ranks them.

Only codes are copied for the meetings, in blocks of bounded size; vectors go where bounds send them.  A frequent vector fills
blocks like any other.  Comparing codes of all queries with all rows is quadratic, as the stated query set asks.

Vectors that are null, of zero length, or holding null or non-finite components take no part.  Vectors of another dimension are another
space: a query's candidates are the rows of its own dimension.  Ties go to the smaller id; repeated rows of an id are separate
candidates (none is a candidate of its own id's query), and a repeated query id is answered once, from the first of its vectors in order of
components.  Empty tables give no rows.  Other columns are dropped.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEED = 20240229
CHUNK = 8192


@functools.lru_cache(4)
def rotation(d: int, bits: int) -> np.ndarray:
    """The first d rows of a random rotation of `bits` dimensions: what turns vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:d]


def width(d: int, bits: int) -> int:
    """Dimensions after padding."""
    return max(bits, -(-d // 8) * 8)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row, vec_id, v and d of the vectors that take part."""
    v = F.col("v")
    found = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return found.filter(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("d"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths (components may be so large that squares overflow)."""
    scale = np.abs(vectors).max(1, keepdims=True)
    small = vectors / scale
    norm = np.linalg.norm(small, axis=1, keepdims=True)
    return small / norm, (norm * scale)[:, 0]


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of the turned unit vectors with their codes."""
    turned, length = unit(vectors)
    turned = turned @ rotation(vectors.shape[1], bits)
    return np.packbits(turned >= 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(bits)


def index(rows: DataFrame, bits: int) -> DataFrame:
    """row, vec_id, d, code, length and own of every row of `usable`."""

    def run(batches):
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                codes, length, own = encode(_matrix(part.column("v")), width(d, bits))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "d")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)], ["row", "vec_id", "d", "code", "length", "own"])

    return rows.mapInArrow(run, "row long, vec_id long, d int, code binary, length double, own double")


def estimates(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray):
    """For chunks of codes: where they begin, estimated inner products with all queries, and the deviations of their errors for queries of length one."""
    bits = 8 * codes.shape[1]
    turned = (queries @ rotation(queries.shape[1], bits)).astype(np.float32)
    for at in range(0, len(codes), CHUNK):
        part = slice(at, at + CHUNK)
        signs = (np.unpackbits(codes[part], axis=1) * np.float32(2) - 1) / np.float32(np.sqrt(bits))
        yield at, (turned @ signs.T) * (length[part] / own[part]), length[part] * np.sqrt(np.maximum(1 - own[part] ** 2, 0) / (own[part] ** 2 * (bits - 1)))


def nearest(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = 768, block: int = 32_768, query_block: int = 4096, sureness: float = 3.5) -> DataFrame:
    """(query_id, rank, vec_id, score, reranked): the k rows of largest inner product for every row that is_query (a condition on vec_id) picks;
    reranked: how many rows the bounds left for the query."""
    rows = written(usable(df, vec_id, embedding), "vectors")
    coded = written(index(rows, bits), "codes")
    asked = written(rows.filter(is_query).groupBy("vec_id", "d").agg(F.min("v").alias("v")).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by(F.struct("v", "d"), "v").alias("x")).select("query_id", "x.v", "x.d"), "queries")
    total, cores = coded.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // block), min(2 * cores, -(-total // 512)), 1)
    query_blocks = max(1, -(-asked.count() // query_block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = 4 * k // blocks + k // 4 + 1
    vectors = coded.withColumn("block", deal("row", blocks)).withColumn("query_block", every(query_blocks))
    column = lambda t, c: t.column(c).combine_chunks()

    def meet(queries: DataFrame, found_by):
        """What found_by(queries, codes, ids that are no candidates) gives for the blocks of queries and codes that meet."""

        def run(key, left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "estimate": pa.array([], pa.float64())})
            turned, norm = unit(_matrix(column(left, "v")))
            codes = np.frombuffer(b"".join(column(right, "code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            q, j, e = found_by(turned, left.column("floor").to_numpy() / norm, left.column("query_id").to_numpy(), codes, *(right.column(c).to_numpy() for c in ("length", "own", "vec_id")))
            return pa.table({"query_id": left.column("query_id").to_numpy()[q], "row": right.column("row").to_numpy()[j], "estimate": e * norm[q]})

        sides = queries.withColumn("query_block", deal("query_id", query_blocks)).withColumn("block", every(blocks))
        keys = ["d", "block", "query_block"]
        return sides.groupBy(keys).cogroup(vectors.groupBy(keys)).applyInArrow(run, "query_id long, row long, estimate double")

    def largest(queries, floor, ids, codes, length, own, vec_ids):
        """The rows of largest estimate, some of each block."""
        out = [np.zeros(0, np.int64)] * 2, np.zeros(0)
        (q, j), e = out
        for at, estimate, _ in estimates(queries, codes, length, own):
            estimate[ids[:, None] == vec_ids[None, at : at + CHUNK]] = -np.inf
            n = min(some, estimate.shape[1])
            top = np.argpartition(estimate, estimate.shape[1] - n, axis=1)[:, -n:]
            q, j = np.concatenate([q, np.repeat(np.arange(len(queries)), n)]), np.concatenate([j, at + top.ravel()])
            e = np.concatenate([e, np.take_along_axis(estimate, top, 1).ravel()])
            order = np.lexsort((-e, q))
            place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            order = order[(place < some) & (e[order] > -np.inf)]
            q, j, e = q[order], j[order], e[order]
        return q, j, e

    def reaching(queries, floor, ids, codes, length, own, vec_ids):
        """Rows whose upper bound reaches the floor."""
        found = []
        for at, estimate, error in estimates(queries, codes, length, own):
            upper = estimate + sureness * error * (1 + 1e-5)
            i, j = np.nonzero((upper >= floor[:, None] - 1e-6 * length[at : at + CHUNK]) & (ids[:, None] != vec_ids[None, at : at + CHUNK]))
            found.append((i, at + j, estimate[i, j].astype(float)))
        return (np.concatenate(x) for x in zip(*found))

    def exact(pairs: DataFrame) -> DataFrame:
        """pairs (query_id, row) with vec_id and score."""
        product = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
        return pairs.join(rows.select("row", "vec_id", "v"), "row").join(asked.select("query_id", F.col("v").alias("w")), "query_id").select("query_id", "vec_id", product.alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "row")
    first = meet(asked.withColumn("floor", F.lit(0.0)), largest).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= 4 * k)
    scores = F.sort_array(F.collect_list("score"), asc=False)  # 4 k numbers at most
    floors = exact(first.select("query_id", "row")).groupBy("query_id").agg(F.coalesce(F.get(scores, F.lit(k - 1)), F.lit(float("-inf"))).alias("floor"))
    near = meet(asked.join(written(floors, "floors"), "query_id"), reaching)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = exact(written(near.select("query_id", "row"), "near")).withColumn("rank", F.row_number().over(order)).withColumn("reranked", F.count("*").over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "reranked")


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")
