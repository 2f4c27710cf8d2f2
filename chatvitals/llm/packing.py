"""Best-fit packing by linear grouping.

Pieces of documents go into sequences of `size` tokens, as few as possible.  Only the number of pieces of each
length matters for the plan, so the plan is made from that histogram (at most `size` rows, whatever the
input), as runs of equal sequences:

1. Pieces longer than `size // 8` are sorted by length and cut into groups of equal cardinality; each group's
   lengths are rounded up to its largest.
2. Configurations of these few sizes are chosen one after another: the largest size left, and the
   best filling of what remains beside it; each is used as often as the counts allow.
3. The actual pieces take the places of their group, longest first, which leaves residual room.
4. Small pieces go, longest first, to the fullest sequence that has room for them.

A piece finds its place by its rank among the pieces of its length.  Ranks come from one range-partitioned, sorted
pass over slim rows and the row counts per partition, so one frequent length is no hot key.

Null text counts as empty: a document of the end token alone.  Repeated documents are packed once per
row.  Empty tables give no rows.  `pieces` drops other columns, `pack` keeps them but for sequence_id and offset, which it makes.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, prefix_hash, range_hash, text_blocks, trim, words, written

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
MOST_STRETCHES = 500_000
BLOCK = 1 << 20
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b",.;:!?")] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


class WordEncoder:
    """Ids of texts.  White space splits before every merge, and so does the place between an ASCII letter or digit and the marks after
    it, so ids of the stretches between are found once, kept by hash, and joined.  Case is folded before the merges, but not in special
    tokens: their strings in a text are those tokens, as the tokenizer has it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def ids(self, blob: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and how many each has."""
        rows = len(bounds) - 1
        if not len(blob):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        low, start, end = words(blob, bounds)
        low = blob if (blob == 0x3C).any() else low
        cut = end.copy()
        while True:
            more = (cut - 1 > start) & _MARK[low[cut - 1]]
            if not more.any():
                break
            cut -= more
        cut = np.where(_PLAIN[low[cut - 1]], cut, end)
        tail = cut < end  # marks of their own
        at = np.arange(len(start)) + np.cumsum(tail) - tail
        first, last = np.empty(len(start) + int(tail.sum()), np.int64), np.empty(len(start) + int(tail.sum()), np.int64)
        first[at], last[at] = start, cut
        first[at[tail] + 1], last[at[tail] + 1] = cut[tail], end[tail]
        hashes, some, of = np.unique(range_hash(prefix_hash(low), first, last), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MOST_STRETCHES:
            self._clear()
        known = self.known
        names = hashes.tolist()
        new = [i for i, h in enumerate(names) if h not in known]
        if new:
            data = low.tobytes()
            self._learn([names[i] for i in new], [data[a:b].decode() for a, b in zip(first[some[new]].tolist(), last[some[new]].tolist())])
        number = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[of]
        sizes = self.sizes[number]
        before = np.cumsum(sizes) - sizes
        where = np.repeat(self.starts[number] - before, sizes) + np.arange(int(sizes.sum()))
        counts = np.bincount(np.searchsorted(bounds[1:], first, "right"), sizes, rows).astype(np.int64)
        return self.flat[where], counts

    def _learn(self, hashes: list[int], stretches: list[str]) -> None:
        plain, other = [], []
        for i, s in enumerate(stretches):  # of letters only, where each is one word for the tokenizer
            t = s.lower()
            (plain if t.isalpha() and max(t) < "\u0250" else other).append(i)
        found: list = [None] * len(stretches)
        for at in range(0, len(plain), 1024):  # many in one call: the tokenizer tells which word each id belongs to
            part = plain[at : at + 1024]
            e = self.tokenizer.encode(" ".join([stretches[i] for i in part]), add_special_tokens=False)
            ids, of = np.array(e.ids, np.uint32), np.array(e.word_ids)
            ends = np.r_[np.flatnonzero(np.diff(of)) + 1, len(of)].tolist()
            if len(ends) != len(part):
                raise ValueError("a word of letters gave several")
            for i, a, b in zip(part, [0, *ends], ends):
                found[i] = ids[a:b]
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([stretches[i] for i in part], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.uint32)
        sizes, n = np.array([len(x) for x in found], np.int64), len(self.known)
        ids = np.concatenate(found)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(found) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(found)], self.sizes[n : n + len(found)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(found))))


@functools.lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end: int = 0) -> DataFrame:
    """Documents as tokens with an end token, cut into pieces of `size` tokens; ids little-endian unsigned 32-bit."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for row, blob, bounds in text_blocks(batch.column("text"), BLOCK):
                ids, counts = encoder.ids(blob, bounds)
                rows, counts = len(counts), counts + 1
                after = np.cumsum(counts)
                out = np.full(int(after[-1]), end, "<u4")
                inner = np.ones(len(out), bool)
                inner[after - 1] = False
                out[inner] = ids
                many = -(-counts // size)
                of = np.repeat(np.arange(rows), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(size, counts[of] - piece * size)
                offsets = np.r_[0, np.cumsum(4 * length)].astype(np.int64)
                binary = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                names = batch.column("doc_id").slice(row, rows).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([names, pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), binary], PIECES.fieldNames())
        trim()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _fillings(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How often to use each size so that the sum is as large as it can be within room (a bounded subset sum over bit sets)."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, s in enumerate(sizes):
        times, k = min(left[i], room // s) if s <= room else 0, 1
        while times > 0:  # binary splitting of the multiplicity
            k = min(k, times)
            new = (reach | reach << (k * s)) & mask
            if new != reach:
                steps.append((i, k, reach))
                reach = new
            times -= k
            k *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, [0] * len(sizes)
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            used[i] += k
            best -= k * sizes[i]
    return used


def plan(histogram: dict[int, int], size: int, groups: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of sequences, pieces per sequence, first sequence, offset) for runs of pieces; ranks of a length are covered without gaps."""
    out, rank, sequences = [], dict.fromkeys(histogram, 0), 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # residual room: runs of sequences
    known: list[int] = []

    def free(room: int, first: int, n: int):
        if n and room:
            if room not in rooms:
                rooms[room] = []
                insort(known, room)
            rooms[room].append((first, n))

    def put(length: int, n: int, per: int, first: int, offset: int):
        out.append((length, rank[length], n, per, first, offset))
        rank[length] += n * per

    small = size // 8
    large = sorted((x for x in histogram if x > small), reverse=True)
    total = sum(histogram[x] for x in large)
    groups = max(1, min(groups, total))
    stock: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group, runs of [length, count], longest first
    g, room_in = 0, -(-total // groups)
    for length in large:
        n = histogram[length]
        while n:
            take = min(n, room_in)
            stock[g].append([length, take])
            n, room_in = n - take, room_in - take
            if not room_in and g + 1 < groups:
                g, room_in = g + 1, -(-total // groups)
    stock = [s for s in stock if s]
    sizes, left = [s[0][0] for s in stock], [sum(n for _, n in s) for s in stock]
    while any(left):
        top = next(i for i, n in enumerate(left) if n)
        rest = left.copy()
        rest[top] -= 1
        use = _fillings(size - sizes[top], sizes, rest)
        use[top] += 1
        times = min(n // u for n, u in zip(left, use) if u)
        slots = [i for i, u in enumerate(use) for _ in range(u)]
        for i, u in enumerate(use):
            left[i] -= u * times
        runs = []
        for i in slots:  # the next `times` pieces of the group
            need, mine = times, []
            while need:
                length, n = stock[i][0]
                k = min(need, n)
                mine.append([length, k])
                need -= k
                stock[i][0][1] -= k
                if n == k:
                    stock[i].pop(0)
            runs.append(mine)
        at = 0
        while at < times:  # stretches in which every slot has one length
            n, offset = min(r[0][1] for r in runs), 0
            for r in runs:
                put(r[0][0], n, 1, sequences + at, offset)
                offset += r[0][0]
                r[0][1] -= n
                if not r[0][1]:
                    r.pop(0)
            free(size - offset, sequences + at, n)
            at += n
        sequences += times
    for length in sorted((x for x in histogram if x <= small), reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(known, length)
            if i == len(known):
                per = size // length
                count = max(1, n // per)
                free(size, sequences, count)
                sequences += count
                continue
            room = known[i]
            first, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], known[i]
            per = room // length
            full = min(count, n // per)
            if not full:
                full, per = 1, n
            put(length, full, per, first, size - room)
            n -= full * per
            free(room - per * length, first, full)
            free(room, first + full, count - full)
    return out


def pack(table: DataFrame, size: int = 2048, groups: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length and more).  The table is read several times: pass a written one."""
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = sorted(plan(counts, size, groups))
    keys = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    cells = np.array(runs, np.int64).reshape(-1, 6)
    names = [c for c in table.columns if c not in ("sequence_id", "offset")]
    place, within, before = free_names(names, "place", "within", "before")
    fields = [table.schema[c] for c in names]

    def ranks(batches):
        from pyspark import TaskContext

        own, length, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            ranks = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.r_[starts, len(lengths)]))
            if lengths[0] == length:
                ranks[: starts[1] if len(starts) > 1 else len(lengths)] += seen
            length, seen = lengths[-1], ranks[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), own)), pa.array(ranks)], [*names, place, within])

    ordered = table.select(*names).repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ranked = written(ordered.mapInArrow(ranks, T.StructType([*fields, T.StructField(place, T.LongType()), T.StructField(within, T.LongType())])), "ranked")
    # a length spans neighbouring partitions: as many rows as partitions and lengths together
    above = Window.partitionBy("length").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("length", place).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(above), F.lit(0)))
    placed = ranked.join(offsets, ["length", place]).select(*names, (F.col(before) + F.col(within)).alias(within))
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column(within).to_numpy()
            row = cells[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(cells) else np.zeros((len(rank), 6), np.int64)
            k = rank - row[:, 1]
            per = np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 4] + k // per), pa.array(row[:, 5] + k % per * length)], [*names, "sequence_id", "offset"])

    return placed.mapInArrow(assign, schema)


def op5_on(docs: DataFrame) -> DataFrame:
    """Packs the texts of `docs` as the query does."""
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return op5_on(read(spark, sf_dir, "documents"))
