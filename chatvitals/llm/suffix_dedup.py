"""Suffix-array dedup: byte strings of a given length that start in two places.

The suffixes that are sorted are sampled so that no repeat is missed.  Windows of `length` bytes are grouped into
runs whose smallest k-gram (by hash) stands at one place; equal windows agree on that place, so only its suffix is needed.
A suffix is held by its leading token (eight bytes, in byte order), then by hashes in place of the bytes that follow: that of its k-gram,
and that of all bytes that its run's windows cover.  Suffixes are range-partitioned by these tokens, with splitters that Spark
samples; a bucket (of about `bucket` suffixes, whatever the input) is sorted by multikey quicksort, neighbours are compared, and the ends of
buckets are compared across boundaries:

* all tokens equal to a neighbour's: every window of the run starts elsewhere too;
* the k-gram equal, the whole not: both runs are cut finer, by a longer k (half the length, then all but a fortieth, then
  all of it, where a run is one window); of equal runs, the first is cut finer for all of them;
* neither: no window of the run repeats.

So suffixes are in byte order by their first eight bytes only; beyond, equal strings stand together, which is all that a comparison of
neighbours at a given length needs.  Ties are broken by document and place, so a suffix that is very frequent spreads over buckets, and each
row only looks at its neighbours: no group is ever gathered.  Hashes have 64 bits (two must agree).

Documents are known by 128 bits: the id (a hash of ids that are no whole numbers) and a hash of id and text.  Null text counts as empty.
Rows that repeat an id with the same text are separate occurrences (each is removed, if long enough).  With `keep_first` the first copy of
each repeat, by id (null last), then hash, then place, stays whole, and the others go, but for bytes that a first copy of another repeat
covers too; rows that repeat an id with the same text are then one document and stay alike.  With `longer_wins` as well, a byte that first copies
and others cover goes the way of the longest run among them, so a few bytes that two copies share by chance beside a passage do not keep its
copy; each cut byte still stands in a copy that starts earlier.  Matches never cross documents.  Empty tables give no
rows.  Texts of any length are taken in whole (a text of many megabytes is a block of its own).  Columns of the input stay; n_bytes, spans, kept and kept_text are added and replace columns of those names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, free_names, mix, near_rows, powers, prefix_hash, range_hash, text_blocks, trim, written

RUNS = "ord long, uid long, first long, last long, lead long, gram long, span long"
_NAMES = ["ord", "uid", "first", "last", "lead", "gram", "span"]

#: Bits of a k-gram's key that hold its place in the block; the same in all blocks, so that equal windows choose alike.
PLACE_BITS = np.uint64(32)


def runs(blob: np.ndarray, wanted: np.ndarray, k: int, length: int):
    """(first window, last window, leading token, k-gram hash, hash of the bytes of all windows) for maximal runs of wanted window starts with one smallest k-gram.

    wanted: a flag for each byte; only starts whose window ends inside their text may be set."""
    n, w = len(blob), length - k + 1
    count = n - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0 or not wanted.any():
        return none, none, none, none, none
    prefix = prefix_hash(blob)
    grams = n - k + 1
    hashes = mix((prefix[k:] - prefix[:-k]) * powers(grams))
    keys = hashes >> PLACE_BITS << PLACE_BITS | np.arange(grams, dtype=np.uint64)
    # sliding minimum from the minima before and after block bounds
    blocks = np.concatenate([keys, np.full(-grams % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:count]
    before = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 : w - 1 + count]
    place = (np.minimum(after, before) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    wanted = wanted[:count]
    begins = np.ones(count, bool)
    begins[1:] = (place[1:] != place[:-1]) | ~wanted[:-1]
    begins &= wanted
    ends = np.ones(count, bool)
    ends[:-1] = begins[1:] | ~wanted[1:]
    ends &= wanted
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = place[first]
    lead = np.zeros(len(at), np.uint64)
    for j in range(8):
        lead = lead << np.uint64(8) | (blob[at + j].astype(np.uint64) if j < k else np.uint64(0))
    lead ^= np.uint64(1 << 63)  # signed numbers in byte order
    return first, last, lead.view(np.int64), hashes[at].view(np.int64), range_hash(prefix, first, last + length).view(np.int64)


def _starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Window starts that end inside their text; a text's last start and the next text's first are never neighbours (length > 1)."""
    steps = np.zeros(int(bounds[-1]) + 1, np.int32)
    room = bounds[1:] - length + 1 > bounds[:-1]
    np.add.at(steps, bounds[:-1][room], 1)
    np.add.at(steps, (bounds[1:] - length + 1)[room], -1)
    return np.cumsum(steps[:-1]) > 0


def _suffixes(docs: DataFrame, k: int, length: int, asked: bool) -> DataFrame:
    """RUNS of docs (ord, uid, text and, if asked, the window ranges to cut finer)."""

    def run(batches):
        for batch in batches:
            number, uid = batch.column("ord").to_numpy(), batch.column("uid").to_numpy()
            for row, blob, bounds in text_blocks(batch.column("text"), 1 << 20):
                wanted = _starts(bounds, length) if bounds[-1] else np.zeros(0, bool)
                if asked:
                    steps = np.zeros(len(wanted) + 1, np.int32)
                    lists = batch.column("asked").slice(row, len(bounds) - 1)
                    flat = lists.flatten()
                    shift = np.repeat(bounds[:-1], np.diff(lists.offsets.to_numpy()))
                    np.add.at(steps, flat.field("first").to_numpy() + shift, 1)
                    np.add.at(steps, flat.field("last").to_numpy() + shift + 1, -1)
                    wanted &= np.cumsum(steps[:-1]) > 0
                first, last, lead, gram, span = runs(blob, wanted, k, length)
                of = np.searchsorted(bounds[1:], first, "right")
                yield pa.RecordBatch.from_arrays([pa.array(number[row + of]), pa.array(uid[row + of]), pa.array(first - bounds[of]), pa.array(last - bounds[of]), pa.array(lead), pa.array(gram), pa.array(span)], _NAMES)
        trim()

    return docs.mapInArrow(run, RUNS)


def multikey_quicksort(columns: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """The order of rows by columns, first column first: three-way splits, and the next column where a column is equal."""
    order = np.arange(len(columns[0]))
    stack = [(0, len(order), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == len(columns):
            continue
        part = order[low:high]
        if high - low <= small:
            order[low:high] = part[np.lexsort([c[part] for c in columns[: depth - 1 if depth else None : -1]])]
            continue
        values = columns[depth][part]
        pivot = np.partition(values[:: max(1, len(values) // 1023)], len(values[:: max(1, len(values) // 1023)]) // 2)[len(values[:: max(1, len(values) // 1023)]) // 2]
        less, equal = values < pivot, values == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[low:high] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        stack += [(low, low + a, depth), (low + a, low + a + b, depth + 1), (low + a + b, high, depth)]
    return order


NEIGHBOURS = f"{RUNS}, state int, place long, edge int"

#: Bits of a run's state: its k-gram also stands in other surroundings (set for the first of equal runs), all of it equals a neighbour, it is
#: the first of equal runs in its bucket.
FINER, EQUAL, HEAD = 1, 2, 4


def marked(names: list[np.ndarray], gram: np.ndarray, span: np.ndarray) -> np.ndarray:
    """States of the sorted runs of one bucket; names: what tells runs apart.

    The buckets around may go on with the first and the last of its runs, so the first of those are cut finer in any case."""
    n = len(gram)
    new_gram, new_span = np.ones(n, bool), np.ones(n, bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new_span[1:] = new_gram[1:] | (span[1:] != span[:-1])
    state = np.zeros(n, np.int32)
    state[1:][~new_span[1:]] |= EQUAL
    state[:-1][~new_span[1:]] |= EQUAL
    heads = np.flatnonzero(new_span)
    head = np.repeat(heads, np.diff(np.append(heads, n)))
    first = np.ones(n, bool)
    for name in names:
        first &= name == name[head]
    state[first] |= HEAD
    group = np.cumsum(new_gram) - 1
    several = np.bincount(group[heads]) > 1
    finer = several[group[heads]]
    finer[[0, -1]] = True
    state[heads[finer]] |= FINER
    return state


def compared(table: DataFrame, bucket: int = 2_000_000) -> DataFrame:
    """(ord, uid, first, last, state) of runs that are EQUAL to others or to be cut FINER; table: RUNS, written.

    A run may come twice, with the state that it has in its bucket and with what a comparison across a boundary adds; a run with EQUAL and
    without HEAD in one of them is not the first of equal runs."""
    buckets = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // bucket))

    def run(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        number, uid, first, last, lead, gram, span = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = multikey_quicksort([lead, gram, span, number, uid, first])
        number, uid, first, last, lead, gram, span = (x[order] for x in (number, uid, first, last, lead, gram, span))
        state = marked([number, uid, first], gram, span)
        edge = np.zeros(len(uid), np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        kept = np.flatnonzero((state & (EQUAL | FINER) > 0) | (edge > 0))
        for at in range(0, len(kept), 50_000):
            k = kept[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[k]) for x in (number, uid, first, last, lead, gram, span, state)), pa.array(np.full(len(k), place)), pa.array(edge[k])], [*_NAMES, "state", "place", "edge"])
        trim()

    found = written(table.repartitionByRange(buckets, "lead", "gram", "span", "ord", "uid", "first").mapInArrow(run, NEIGHBOURS), "neighbours")
    # the last row of each bucket against the first of the next one; a splitter is a row of the bucket that it ends, so only the last can be empty
    side = lambda bit, step: found.filter(F.col("edge").bitwiseAND(bit) > 0).select((F.col("place") + step).alias("next"), "gram", "span", F.struct("ord", "uid", "first", "last", "state").alias(f"at{bit}"))
    met = side(2, 1).join(side(1, 0), ["next", "gram", "span"])
    own = lambda at, state: F.struct(*(F.col(at)[c].alias(c) for c in ("ord", "uid", "first", "last")), state.cast("int").alias("state"))
    across = met.select(F.explode(F.array(own("at2", F.col("at2.state").bitwiseAND(HEAD).bitwiseOR(EQUAL)), own("at1", F.lit(EQUAL)))).alias("r")).select("r.*")
    return found.select("ord", "uid", "first", "last", "state").unionByName(across)


def _merged(ranges) -> list[tuple[int, int]]:
    """The union of ranges (start, end), in order; those that touch are one."""
    out = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _without(ranges, others) -> list[tuple[int, int]]:
    """Merged ranges without what merged others cover."""
    out, i = [], 0
    for start, end in ranges:
        while i < len(others) and others[i][1] <= start:
            i += 1
        j = i
        while j < len(others) and others[j][0] < end:
            if others[j][0] > start:
                out.append((start, others[j][0]))
            start = max(start, others[j][1])
            j += 1
        if start < end:
            out.append((start, end))
    return out


def _outweighed(copies, firsts, length: int, data: bytes) -> list[tuple[int, int]]:
    """The bytes that copies cover, without those of a first copy at least as long (in windows; the first copy wins a tie).

    A copy that goes on with the first copy before it, as in a text that repeats itself, leaves that one whole."""
    reach, out = length - 1, []
    starts, ends = [a for a, _ in firsts], [b for _, b in firsts]
    for a, b in copies:
        near = firsts[bisect_right(ends, a - reach) : bisect_left(starts, b + reach)]
        firm = [(c, d + reach) for c, d in near if d - c >= b - a or (d == a and data.find(data[a : a + length], c, d + reach) >= 0)]
        out += _without([(a, b + reach)], _merged(firm))
    return _merged(out)


def removed(found, length: int, longer_wins: bool = False, data: bytes = b"") -> list[tuple[int, int]]:
    """The bytes to cut, from found window ranges (first, last, whether these are first copies that stay) of data."""
    copies = _merged((r["first"], r["last"] + 1) for r in found if not r["stays"])
    firsts = _without(_merged((r["first"], r["last"] + 1) for r in found if r["stays"]), copies)
    if longer_wins:
        return _outweighed(copies, firsts, length, data)
    cover = lambda windows: _merged((a, b - 1 + length) for a, b in windows)
    return _without(cover(copies), cover(firsts))


def repeats(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", keep_first: bool = False, longer_wins: bool = False) -> DataFrame:
    """df with n_bytes, spans (removed runs: start and end in bytes), kept (the bytes left) and kept_text (the same without parts of
    characters that a cut leaves).  keep_first: one copy of each repeat stays; longer_wins: where it overlaps others, the longer has its way."""
    cols = [c for c in df.columns if c not in ("n_bytes", "spans", "kept", "kept_text")]
    number, own, hits = free_names(cols, "ord", "uid", "found")
    whole_number = isinstance(df.schema[doc_id].dataType, T.IntegralType)
    name = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)) if whole_number else F.xxhash64(F.col(doc_id), F.lit(1))
    docs = df.select(*cols).withColumn(number, name).withColumn(own, F.xxhash64(F.col(doc_id), F.col(text)))
    slim = docs.select(F.col(number).alias("ord"), F.col(own).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.filter(F.octet_length("text") >= length)
    covered, asked = None, None
    for k in (max(1, length // 2), length - max(1, length // 40), length):
        source = slim
        if asked is not None:
            ranges = asked.groupBy("ord", "uid").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
            source = near_rows(slim, asked, "uid").join(ranges, ["ord", "uid"])
        table = written(_suffixes(source, k, length, asked is not None), "suffixes")
        found = compared(table)
        drop_written(table)
        has = lambda bit: F.col("state").bitwiseAND(bit) > 0
        stays = has(HEAD) if keep_first else F.lit(False)
        here = found.filter(has(EQUAL)).select("ord", "uid", "first", "last", stays.alias("stays"))
        covered = here if covered is None else covered.unionByName(here)
        asked = found.filter(has(FINER)).select("ord", "uid", "first", "last")
    covered = covered.select(F.col("ord").alias(number), F.col("uid").alias(own), "first", "last", "stays")
    ranges = covered.groupBy(number, own).agg(F.collect_list(F.struct("first", "last", "stays")).alias(hits))
    span, whole = "array<struct<start:long,end:long>>", F.coalesce(F.col(text), F.lit(""))
    clean = near_rows(docs, covered, own, "left_anti").select(*cols, F.octet_length(whole).cast("long").alias("n_bytes"), F.array().cast(span).alias("spans"), whole.cast("binary").alias("kept"), whole.alias("kept_text"))
    hit = near_rows(docs, covered, own).join(ranges, [number, own], "left").select(*cols, hits)
    schema = T.StructType([*(df.schema[c] for c in cols), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T._parse_datatype_string(span)), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            sizes, spans, kept, texts = [], [], [], []
            for t, found in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist()):
                data, left, at = (t or "").encode(), [], 0
                mine = removed(found or (), length, longer_wins, data)
                for start, end in mine:
                    left.append(data[at:start])
                    at = end
                left.append(data[at:])
                sizes.append(len(data))
                spans.append([{"start": start, "end": end} for start, end in mine])
                kept.append(b"".join(left))
                texts.append("".join([x.decode("utf-8", "ignore") for x in left]))  # only the ends of a stretch can be broken
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.large_binary()), pa.array(texts, pa.large_string())], [*cols, "n_bytes", "spans", "kept", "kept_text"])
        trim()

    return clean.unionByName(hit.mapInArrow(cut, schema))


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import read

    done = repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))
