"""LM scoring by a probabilistic suffix tree.

Texts are sequences of words between two ends; the first end is only a context.  Of all runs of 2 to `depth` + 1 words those that
occur `least` times are counted (`_grams`), so what the model gathers follows the corpus.  A run is a symbol (its last word) behind a context:

* p(symbol | context) = (n + kinds * below) / (all + kinds): n occurrences of the run, `all` of the context; below is the probability
  behind the context's suffix; kinds is the number of counted symbols and of all occurrences of others (as if each were another symbol).
* A symbol is kept at a context if p and below are apart by `ratio`.  A context is retained if its suffix is and the divergence of its
  kept symbols, in nats over all its occurrences, exceeds `gain` per symbol.  So contexts have as many words as the data support,
  up to `depth`.
* Symbols that are not kept get below times a factor that makes the distribution sum to 1.
* The root is add-one over the words of the training rows, one unknown word and the end.

A token is scored at the longest retained suffix of what stands before it.  As suffixes of retained contexts are retained, its
logarithm is the root's plus one term for each retained context before it (the factor) and one for each kept symbol.

Work in Spark: tasks count in blocks, blocks are packed by key range and meet in a shuffle (a hot run is one entry a block); runs of two
come first, so that longer ones are only counted where all their pairs are frequent.  The tests are joins and sums of tables.
Terms and word counts are tables too: the most frequent (`held` of each at most) are broadcast, the others meet
what the texts ask for in a shuffle, per document and distinct key, packed in the same way.  Bloom filters of fixed size leave out what surely is not in a table.

Words are 64-bit hashes of their lower-cased (A-Z) bytes, runs 64-bit hashes of those.  Null text counts as empty: an end alone.
Repeated rows are each scored and each counted.  Without training rows every word is unknown.  Empty tables give no rows.  Columns of the
input stay; n_tokens, n_known, train_tokens, base_score and score are added and replace columns of those names.
"""

from __future__ import annotations

import gc
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, MIX2, drop_written, mix, prefix_hash, range_hash, text_blocks, trim, words, written

END = np.uint64(0x0123456789ABCDEF)
BITS = 1 << 27  # of a Bloom filter
PROBES = (0, 18, 37)
BUFFER = 1_000_000  # entries counted at once
BLOCK = 1 << 20
PART = 2_000_000  # tokens for each part of a shuffle of counts


def tokens(column):
    """For runs of rows: first row, hash of each word between two ENDs a text, the row of each, counted from the first, and its place in its text (0: the first END)."""
    for first, blob, bounds in text_blocks(column, BLOCK):
        rows = len(bounds) - 1
        if len(blob):
            low, start, end = words(blob, bounds)
            hashes = range_hash(prefix_hash(low), start, end)
        else:
            start, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        lengths = np.bincount(np.searchsorted(bounds[1:], start, "right"), minlength=rows) + 2
        after = np.cumsum(lengths)
        out, inner = np.full(int(after[-1]), END), np.ones(int(after[-1]), bool)
        inner[after - 1] = inner[after - lengths] = False
        out[inner] = hashes
        row = np.repeat(np.arange(rows), lengths)
        yield first, out, row, np.arange(len(out)) - (after - lengths)[row]


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a run of words from those of the runs without its last and without its first word."""
    return mix(prefix * BASE + suffix)


class Sums:
    """Counts by key, merged as they come; given out when they are many."""

    def __init__(self, most: int = 1_500_000):
        self.keys, self.counts, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        self.keys = keys

    def full(self) -> bool:
        return len(self.keys) > self.most

    def given(self):
        out = pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], ["key", "n"])
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def _words(texts: DataFrame) -> DataFrame:
    """(key, n) of words and ends."""

    def run(batches):
        sums = Sums()
        for batch in batches:
            for _, hashes, _, place in tokens(batch.column(0)):
                keys, n = np.unique(hashes[place > 0].view(np.int64), return_counts=True)
                sums.add(keys, n)
                if sums.full():
                    yield sums.given()
        yield sums.given()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where each distinct one begins in it."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _blocks(part: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Columns of entries ordered by part, packed for each part."""
    if not len(part):
        return [], []
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    return part[bounds[:-1]].tolist(), [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(bounds, bounds[1:])]


def _unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(block) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(block, kind, n, at))
        at += n * size
    return out


def _dealt(spark, total: int) -> tuple[int, int]:
    """How many tasks deal with the counts of `total` tokens, and in how many parts, so that parts are dealt evenly and a task holds one at a time."""
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART), 20_000)
    return tasks, max(4 * tasks, 4 * total // PART)


def _counted(texts: DataFrame, runs_of, total: int, least: int) -> DataFrame:
    """(size, prefix, suffix, key, n) of runs that occur `least` times.  runs_of gives (size, prefixes, suffixes) for tokens and places.

    Blocks of distinct runs with their counts are packed for each part of the key space and sorted by part, so a reducer holds one part."""

    tasks, parts = _dealt(texts.sparkSession, total)

    def packed(size, prefix, suffix):
        whole = np.concatenate(prefix), np.concatenate(suffix)
        prefix.clear()
        suffix.clear()
        prefix, suffix = whole
        key = joined(prefix, suffix)
        order, start = _ordered(key)
        n = np.diff(np.r_[start, len(key)]).astype("<u4")
        at = order[start]
        key, prefix, suffix = key[at], prefix[at], suffix[at]
        part, blocks = _blocks(((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), prefix, suffix, n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), size, np.int32)), pa.array(part, pa.int64()), pa.array(blocks, pa.binary())], ["size", "part", "block"])

    def run(batches):
        waiting, many = {}, 0
        for batch in batches:
            for _, hashes, _, place in tokens(batch.column(0)):
                for size, prefix, suffix in runs_of(hashes, place):
                    mine = waiting.setdefault(size, ([], []))
                    mine[0].append(prefix)
                    mine[1].append(suffix)
                    many += len(prefix)
                if many >= BUFFER:
                    yield from (packed(size, *x) for size, x in waiting.items())
                    waiting, many = {}, 0
        yield from (packed(size, *x) for size, x in waiting.items())
        waiting.clear()
        trim()

    def summed(size, blocks):
        prefix, suffix, n = (np.concatenate(x) for x in zip(*(_unpacked(b, "<u8", "<u8", "<u4") for b in blocks)))
        key = joined(prefix, suffix)
        order, start = _ordered(key)
        n = np.add.reduceat(n[order].astype(np.int64), start)
        often = n >= least
        at = order[start[often]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), *(pa.array(x[at].view(np.int64)) for x in (prefix, suffix, key)), pa.array(n[often])], ["size", "prefix", "suffix", "key", "n"])

    def merge(batches):
        waiting, at = [], None
        for batch in batches:
            for size, part, block in zip(batch.column("size").to_pylist(), batch.column("part").to_pylist(), batch.column("block")):
                if waiting and at != (size, part):
                    yield summed(at[0], waiting)
                    waiting = []
                at = size, part
                waiting.append(block.as_py())
        if waiting:
            yield summed(at[0], waiting)
        waiting.clear()
        trim()

    blocks = texts.mapInArrow(run, "size int, part long, block binary")
    dealt = blocks.repartition(tasks, "size", "part").sortWithinPartitions("size", "part")
    return dealt.mapInArrow(merge, "size int, prefix long, suffix long, key long, n long")


class Bloom:
    """What may be among the keys of a table: few others pass, none of them is missed.  Its size is fixed."""

    def __init__(self):
        self.bytes = np.zeros(BITS // 8, np.uint8)

    def add(self, keys: DataFrame) -> None:
        bits = F.array(*(F.shiftrightunsigned(F.col(keys.columns[0]), s).bitwiseAND(BITS - 1) + 1 for s in PROBES))
        x = keys.select(F.explode(bits).alias("x"))
        segments = x.groupBy(F.bitmap_bucket_number("x").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).toArrow()
        for at, bits in zip(segments.column("at").to_pylist(), segments.column("bits").to_pylist()):
            self.bytes[(at - 1) * len(bits) : at * len(bits)] |= np.frombuffer(bits, np.uint8)

    def may(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        at = np.arange(len(keys))
        for s in PROBES:
            bit = (keys[at] >> np.uint64(s)) & np.uint64(BITS - 1)
            ok = self.bytes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
            out[at[~ok]] = False
            at = at[ok]
        return out


class Lookup:
    """Values by 64-bit key in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = max(16, 1 << int(2 * len(keys)).bit_length())
        self.slots, self.full, self.values = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size)
        at, left = keys & np.uint64(size - 1), np.arange(len(keys))
        while len(left):
            open_ = ~self.full[at]
            slot, first = np.unique(at[open_], return_index=True)
            put = left[open_][first]
            self.slots[slot], self.values[slot], self.full[slot] = keys[put], values[put], True
            again = np.ones(len(left), bool)
            again[np.flatnonzero(open_)[first]] = False
            at, left = (at[again] + np.uint64(1)) & np.uint64(size - 1), left[again]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        mask = np.uint64(len(self.slots) - 1)
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        at, left = keys & mask, np.arange(len(keys))
        while len(left):
            full = self.full[at]
            same = full & (self.slots[at] == keys[left])
            found = left[same]
            hit[found], out[found] = True, self.values[at[same]]
            on = full & ~same
            at, left = (at[on] + np.uint64(1)) & mask, left[on]
        return hit, out


#: Contexts are runs as well; as terms they have keys of their own.
CONTEXT = np.uint64(MIX2)


@dataclass
class Model:
    total: int
    distinct: int
    words: Lookup  # log10 of (count + 1) of the most frequent words
    depth: int = 0  # of the longest retained context
    terms: Lookup = None  # the most frequent terms
    contexts: Bloom = None  # all contexts
    kept: Bloom = None  # all kept symbols
    rest: DataFrame = None  # (key, known, value) of words and terms that are not held

    def added(self, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the held terms add to each token's logarithm, and other keys that may be terms, with the token of each."""
        out, keys, of = np.zeros(len(hashes)), [], []
        context, at = hashes, np.flatnonzero(place > 0)  # tokens whose context of k words may be retained
        for k in range(1, self.depth + 1):
            run = np.zeros(len(hashes), np.uint64)
            run[1:] = joined(context[:-1], context[1:])
            before = context[at - 1]
            hit, value = self.terms.get(before ^ CONTEXT)
            out[at] += value
            may = hit.copy()
            may[~hit] = self.contexts.may(before[~hit])
            ask = may & ~hit
            keys.append(before[ask] ^ CONTEXT)
            of.append(at[ask])
            at = at[may]
            symbol = run[at]
            hit, value = self.terms.get(symbol)
            out[at] += value
            ask = ~hit
            ask[ask] = self.kept.may(symbol[ask])
            keys.append(symbol[ask])
            of.append(at[ask])
            at, context = at[place[at] > k], run
        return out, np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *of])


def fit(train: DataFrame, depth: int = 3, least: int = 3, ratio: float = 1.1, gain: float = 2.0, held: int = 1_000_000) -> Model:
    """train: one column of texts.  depth: words of the longest context; held: how many words and terms are broadcast (it changes the work, not the result)."""
    counts = written(_words(train), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows, rest = _split(counts.select("key", "n", F.log10(F.col("n") + 1).alias("value")), held)
    model = Model(int(total), int(distinct), Lookup(*rows))
    model.rest = rest.select("key", F.lit(True).alias("known"), "value")
    if not total:
        return model
    terms, made = _grow(model, train, counts, depth, least, ratio, gain)
    rows, rest = _split(_union(terms), held)
    model.terms = Lookup(*rows)
    model.rest = written(model.rest.unionByName(rest.select("key", F.lit(False).alias("known"), "value")), "rest")
    for df in (*made, counts):
        drop_written(df)
    return model


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _split(table: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """Keys and values of the most frequent rows (key, n, value), `most` at most, and the table of the others."""
    step = F.floor(F.log2("n") * 16)  # few distinct ones, so the border is found from a histogram
    steps = sorted(((r["step"], r["m"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()), reverse=True)
    above, lowest = 0, math.inf
    for s, m in steps:
        above += m
        if above > most:
            break
        lowest = s
    rows = table.filter(step >= F.lit(lowest)).select("key", "value").toArrow()
    return (rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()), table.filter(step < F.lit(lowest))


def _free(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does so when the driver collects garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _grams(train: DataFrame, depth: int, least: int, total: int) -> list[DataFrame]:
    """(size, prefix, suffix, key, n) of runs of two and of runs of 3 to depth + 1 words that occur `least` times."""

    def pairs_of(hashes, place):
        at = np.flatnonzero(place > 0)
        yield 2, hashes[at - 1], hashes[at]

    often, bloom = written(_counted(train, pairs_of, total, least), "pairs"), Bloom()
    bloom.add(often.select("key"))
    pairs = train.sparkSession.sparkContext.broadcast(bloom)
    _free(often)

    def longer_of(hashes, place):
        at, run = np.flatnonzero(place > 0), hashes
        for size in range(2, depth + 2):
            prefix, suffix = run[at - 1], run[at]
            made = joined(prefix, suffix)
            if size == 2:
                ok = pairs.value.may(made)
                at, made = at[ok], made[ok]
            else:
                yield size, prefix, suffix
            next_, good = np.zeros(len(run), np.uint64), np.zeros(len(run), bool)
            next_[at], good[at] = made, True
            # one word more: the run that ends here and the one that ends a word before
            at, run = at[good[at - 1] & (place[at] >= size)], next_

    longer = written(_counted(train, longer_of, total, least), "grams")
    pairs.unpersist()
    _free(longer)
    return [often, longer]


def _grow(model: Model, train: DataFrame, counts: DataFrame, depth: int, least: int, ratio: float, gain: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tests contexts of one word, of two, and so on, while any is retained.  Returns terms (key, n, value) and the written tables that they come from."""
    counted, norm = _grams(train, depth, least, model.total), math.log10(model.total + model.distinct + 1)
    grams = _union(counted)
    _free(grams)
    model.contexts, model.kept = Bloom(), Bloom()
    below = counts.select(F.col("key").alias("suffix"), (F.log10(F.col("n") + 1) - norm).alias("below"))
    occurrences = counts.select(F.col("key").alias("prefix"), F.col("n").alias("all"))
    terms, made = [], [*counted]
    for k in range(1, depth + 1):
        here = grams.filter(F.col("size") == k + 1).select("prefix", "suffix", "key", "n")
        contexts = here.groupBy("prefix").agg(F.sum("n").alias("of"), F.count("*").alias("kinds")).join(occurrences, "prefix").select("prefix", "all", (F.col("kinds") + F.col("all") - F.col("of")).alias("kinds"))
        edges = here.join(below, "suffix").join(contexts, "prefix").withColumn("ps", F.pow(F.lit(10.0), "below"))
        edges = edges.withColumn("p", (F.col("n") + F.col("kinds") * F.col("ps")) / (F.col("all") + F.col("kinds")))
        edges = written(edges.select("prefix", "key", "n", "all", "below", "ps", "p", ((F.col("p") >= ratio * F.col("ps")) | (F.col("p") * ratio <= F.col("ps"))).alias("apart")), "edges")
        sums = edges.filter("apart").groupBy("prefix").agg(F.max("all").alias("n"), F.count("*").alias("number"), F.sum(F.col("n") * F.log(F.col("p") / F.col("ps"))).alias("divergence"), F.sum("p").alias("left"), F.sum("ps").alias("rest"))
        factor = F.log10(F.greatest(1 - F.col("left"), F.lit(1e-9)) / F.greatest(1 - F.col("rest"), F.lit(1e-9)))
        held = written(sums.filter(F.col("divergence") > gain * F.col("number")).select(F.col("prefix").bitwiseXOR(F.lit(int(CONTEXT.view(np.int64)))).alias("key"), "n", factor.alias("value"), "prefix"), "contexts")
        made.append(held)
        if not held.limit(1).count():
            drop_written(edges)
            break
        log = F.when(F.col("apart"), F.log10("p")).otherwise(F.col("below") + F.col("factor"))
        value = F.when(F.col("apart"), F.log10("p") - F.col("below") - F.col("factor"))
        tested = written(edges.join(held.select("prefix", F.col("value").alias("factor")), "prefix").select("key", "n", log.alias("log"), value.alias("value")), "symbols")
        made.append(tested)
        terms += [held.select("key", "n", "value"), tested.filter("value is not null").select("key", "n", "value")]
        model.contexts.add(held.select("prefix"))
        model.kept.add(terms[-1].select("key"))
        model.depth = k
        drop_written(edges)
        _free(tested)
        below = tested.select(F.col("key").alias("suffix"), F.col("log").alias("below"))
        occurrences = here.select(F.col("key").alias("prefix"), F.col("n").alias("all"))
    return terms or [grams.select("key", "n", F.lit(0.0).alias("value")).limit(0)], made


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
TERMS, ASKED, ROWS, ANSWERS = range(4)  # kinds of rows that the scoring shuffles hold, in the order in which a part needs them


_TERM, _ASKED, _ANSWER = ("<u8", "<f8", "?"), ("<u8", "<u4", "<u4"), ("<u4", "<f8", "<f8", "<u4")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to docs; text is dropped.

    Tasks score with what is held and ask for the rest: keys, packed for each part of the key space, meet the packed terms of that
    part in one shuffle; the answers, summed per document, meet the rows of the task that asked in another.  Rows are known by their place in their
    task, so a task that runs again has to see docs in the same order: a scan of files does, a shuffle only where rows are sorted after it."""
    kept = [c for c in docs.columns if c != text and c not in RESULTS]
    rest, shared_model = model.rest, docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))  # arrays of bounded size
    norm, spark = math.log10(model.total + model.distinct + 1), docs.sparkSession
    tasks, parts = _dealt(spark, model.total)
    row_type = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)] or [T.StructField("none", T.BooleanType())])
    numbers = [T.StructField(n, t()) for n, t in (("n_tokens", T.LongType), ("n_known", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType))]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("source", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("number", T.LongType()), T.StructField("row", row_type), *numbers])
    names, packed = schema.fieldNames(), ("kind", "part", "source", "block")
    part_of = lambda key: ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def shared(kind, source, part, blocks, row=None):
        """Packed rows; with the other columns if their types are given."""
        n = len(part)
        out = [pa.array(np.full(n, kind, np.int32)), pa.array(part, pa.int64()), pa.array(np.full(n, source, np.int64)), pa.array(blocks, pa.binary())]
        if row is None:
            return pa.RecordBatch.from_arrays(out, packed)
        return pa.RecordBatch.from_arrays([*out, pa.nulls(n, pa.int64()), pa.nulls(n, row), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names)

    def terms(batches):
        waiting, many = [], 0

        def held():
            key, value, known = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(key)
            key = key[order]
            return shared(TERMS, 0, *_blocks(part_of(key), key, value[order], known[order]))

        for batch in batches:
            waiting.append((batch.column("key").to_numpy().view(np.uint64), batch.column("value").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)))
            many += batch.num_rows
            if many >= BUFFER:
                yield held()
                many = 0
        if waiting:
            yield held()
        trim()

    def ask(batches):
        from pyspark import TaskContext

        model, own, seen, turn, waiting, many, row = shared_model.value, TaskContext.get().partitionId(), 0, 0, [], 0, None

        def asked():
            key, number = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(key, kind="stable")
            key, number = key[order], number[order]
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (number[1:] != number[:-1])]) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.r_[at, len(key)]).astype("<u4")
            return shared(ASKED, source, *_blocks(part_of(key[at]), key[at], number[at].astype("<u4"), times), row)

        for batch in batches:
            row = batch.schema.field("row").type
            for first, hashes, of_row, place in tokens(batch.column("text")):
                source, rows = (own << 24) + turn, int(of_row[-1]) + 1
                inside = place > 0
                hit, root = model.words.get(hashes)
                hit, root = hit & inside, np.where(inside, root - norm, 0.0)
                logs, keys, of = model.added(hashes, place)
                logs += root
                rare = inside & ~hit
                key, number = np.concatenate([hashes[rare], keys]), np.concatenate([of_row[rare], of_row[of]])
                order = np.argsort(number, kind="stable")
                waiting.append((key[order], number[order] + seen))
                many += len(key)
                values = [pa.array(np.bincount(of_row, x, rows).astype(t)) for x, t in ((inside, np.int64), (hit, np.int64), (root, float), (logs, float))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, ROWS, np.int32)), pa.array((own + np.arange(seen, seen + rows) // 16) % parts), pa.array(np.full(rows, source)), pa.nulls(rows, pa.binary()), pa.array(np.arange(seen, seen + rows)), batch.column("row").slice(first, rows), *values], names)
                seen += rows
                if many >= BUFFER:
                    yield asked()
                    many, turn = 0, turn + 1
        if waiting:
            yield asked()
        trim()

    def answer(batches):
        at, held, table = None, [], None
        for batch in batches:
            kinds, row = batch.column("kind").to_numpy(), batch.schema.field("row").type
            whole = np.flatnonzero(kinds == ROWS)
            if len(whole):
                yield batch.take(pa.array(whole))
            few = batch.take(pa.array(np.flatnonzero(kinds != ROWS)))
            for kind, part, source, block in zip(*(few.column(c).to_pylist() for c in packed)):
                if part != at:
                    at, held, table = part, [], None
                if kind == TERMS:
                    held.append(_unpacked(block, *_TERM))
                    continue
                if not held:
                    continue
                if table is None:
                    key, value, known = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(key)
                    table = key[order], value[order], known[order]
                key, number, times = _unpacked(block, *_ASKED)
                slot = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
                hit = table[0][slot] == key
                slot, number, times = slot[hit], number[hit], times[hit]
                if not len(number):
                    continue
                value, word = table[1][slot] * times, table[2][slot]
                low = int(number.min())
                sums = [np.bincount(number - low, x) for x in (value, value * word, times * word, np.ones(len(number)))]
                some = np.flatnonzero(sums[3])
                yield shared(ANSWERS, source, [part], [b"".join([(some + low).astype("<u4").tobytes(), sums[0][some].tobytes(), sums[1][some].tobytes(), sums[2][some].astype("<u4").tobytes()])], row)

    def add(batches):
        at, more = None, []
        for batch in batches:
            sources, kinds = batch.column("source").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (sources[1:] != sources[:-1]) | (kinds[1:] != kinds[:-1]), True]) if len(kinds) else []
            for a, b in zip(cuts, cuts[1:]):
                if sources[a] != at:
                    at, more = sources[a], []
                part = batch.slice(a, b - a)
                if kinds[a] == ANSWERS:
                    more += [_unpacked(x, *_ANSWER) for x in part.column("block").to_pylist()]
                    continue
                number = part.column("number").to_numpy()
                got = [part.column(f.name).to_numpy() for f in numbers]
                if more:
                    of, *sums = (np.concatenate(x) for x in zip(*more))
                    mine = np.flatnonzero((of >= number.min()) & (of <= number.max()))
                    low = int(number.min())
                    all_, base, words_ = (np.bincount(of[mine] - low, x[mine], int(number.max()) - low + 1)[number - low] for x in sums)
                    got = [got[0], got[1] + words_.astype(np.int64), got[2] + base, got[3] + all_]
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, got)], ["row", *(f.name for f in numbers)])

    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept))) if kept else F.struct(F.lit(None).cast("boolean").alias("none"))
    asking = docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(ask, schema)
    held = rest.mapInArrow(terms, "kind int, part long, source long, block binary")
    met = asking.unionByName(held, allowMissingColumns=True).repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, schema)
    done = met.repartition(tasks, "source").sortWithinPartitions("source", F.desc("kind"), "number").mapInArrow(add, T.StructType([T.StructField("row", row_type), *numbers]))
    done = written(done, "scored")
    return done.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import crc_mod, read

    docs = read(spark, sf_dir, "documents", ("doc_id", "text"), ordered=True).select("doc_id", "text", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")).select("text"))
    return score(docs, model).select("doc_id", "held_out", *RESULTS)
