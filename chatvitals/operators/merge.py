"""Fragments of one sender within a minute of the first become one message.

Anchored: a fragment joins while its time is at most merge_seconds after the *first* of its message (earlier times join too).  Stickers and images
stand alone.  One sorted pass per group carries nothing but the open message.

Giant groups come in lanes (operators.lanes), each passed on its own once it is known which message is open where it begins.  That depends on all
lanes before, and is found by pointer jumping:

* A lane with a change of sender, sticker or image in it, or before it, leaves a message open that only its own rows decide.
* Through any other lane the open message goes on: whichever anchor comes in, the next one is the first row later than the anchor's limit.  Such a row
  is later than all rows of the lane before it, and so are the anchors after it; for each row of this kind one walk gives the anchor that leaves.
* So each anchor that can leave a lane points to the one that leaves the next lane with a row beyond its limit; pointers are doubled, so a
  stretch of n lanes takes log2(n) rounds of joins from the anchors that are known to those of all lanes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions.text import strip
from ..held import once
from .lanes import LANE, by


def _fields(batch: pa.RecordBatch, keys: list[str], extra: tuple = ()) -> tuple[np.ndarray, ...]:
    """Whether each row but the first begins another group or sender, whether it stands alone, and its time in microseconds."""
    other = np.ones(batch.num_rows, bool)
    same = None
    for name in (*keys, "sender"):
        c = batch.column(name)
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))) if name != "sender" else pc.fill_null(pc.equal(a, b), False)
        same = equal if same is None else pc.and_(same, equal)
    if batch.num_rows > 1:
        other[1:] = ~same.to_numpy(zero_copy_only=False)
    alone = pc.or_(pc.fill_null(batch.column("is_sticker"), False), pc.fill_null(batch.column("is_image"), False)).to_numpy(zero_copy_only=False)
    return other, alone, batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _pass(keys: list[str], limit: int, incoming: dict):
    """A pass over sorted rows; incoming: by (group, lane), the (seq, time) of the anchor that is open where the lane begins."""

    def run(batches):
        held = last = None  # the open message: its row and texts; the last row's keys, sender and whether it stands alone
        anchor = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            other, alone, ts = _fields(batch, keys)
            row = lambda i: (tuple(batch.column(k)[i].as_py() for k in keys), batch.column("sender")[i].as_py(), bool(alone[i]))  # noqa: E731, B023
            begins = other | alone
            begins[1:] |= alone[:-1]
            first = row(0)
            begins[0] = alone[0] or last is None or first[:2] != last[:2] or last[2] or first[1] is None
            lanes = {0: first[0]} if last is None or first[0] != last[0] else {}
            if incoming:
                change = np.flatnonzero(other[1:]) + 1
                lanes |= {int(i): k for i in change if (k := row(int(i))[0]) != row(int(i) - 1)[0]}
            at = {i: incoming[k] for i, k in lanes.items() if k in incoming}
            heads = {}
            flags = np.zeros(len(ts), bool)
            new = begins.tolist()
            for i, t in enumerate(ts.tolist()):
                if i in at:  # the message that came in goes on, or ends here
                    heads[i], anchor = at[i][0], at[i][1]
                    flags[i] = True
                    if t - anchor > limit:
                        del heads[i]
                        anchor = t
                elif new[i] or t - anchor > limit:
                    flags[i], anchor = True, t
            last = row(len(ts) - 1)
            firsts = np.flatnonzero(flags)
            texts = batch.column("text")
            if held is not None and (not len(firsts) or firsts[0] > 0):
                held[1].extend(texts.slice(0, int(firsts[0]) if len(firsts) else len(ts)).to_pylist())
            if not len(firsts):
                continue
            if held is not None:
                yield _closed(*held)
            ends = np.append(firsts[1:], len(ts))
            done = batch.take(pa.array(firsts[:-1]))
            many = np.flatnonzero(ends[:-1] - firsts[:-1] > 1)
            if len(many) or heads:
                column, seq = done.column("text").to_pylist(), done.column("seq").to_pylist()
                for m in many:
                    column[m] = _joined(texts.slice(int(firsts[m]), int(ends[m] - firsts[m])).to_pylist())
                for i, s in heads.items():
                    m = int(np.searchsorted(firsts, i))
                    if m < len(seq):
                        seq[m] = s
                done = _with(_with(done, "text", column), "seq", seq)
            yield done
            i = int(firsts[-1])
            held = batch.slice(i, 1), texts.slice(i).to_pylist(), heads.get(i)
        if held is not None:
            yield _closed(*held)

    return run


def _joined(texts: list) -> str | None:
    return None if None in texts else " ".join(texts)


def _with(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    field = batch.schema.field(name)
    return batch.set_column(batch.schema.get_field_index(name), field, pa.array(values, field.type))


def _closed(row: pa.RecordBatch, texts: list, seq) -> pa.RecordBatch:
    out = _with(row, "text", [_joined(texts)])
    return out if seq is None else _with(out, "seq", [seq])


def _walk(begin: int, times: np.ndarray, limit: int) -> int:
    """The last anchor of rows with rising times, from an anchor on."""
    while True:
        following = int(np.searchsorted(times, times[begin] + limit, "right"))
        if following == len(times):
            return begin
        begin = following


def _leaving(keys: list[str], limit: int, goes_on: set):
    """Per lane: (node_seq, node_ts, at_seq, at_ts) - the anchor that leaves the lane if `at` is an anchor in it; at is null if the lane's own rows decide."""

    def lane(name, other, alone, ts, seq):
        begins = other | alone
        begins[1:] |= alone[:-1]
        begins[0] = name not in goes_on
        start = np.flatnonzero(begins)
        own = bool(len(start))
        rows = np.arange(int(start[-1]) if own else 0, len(ts))
        before = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min], ts[rows][:-1]]))
        rows = rows[ts[rows] > before]  # later than all before
        times = ts[rows]
        if own:
            end = rows[_walk(0, times, limit)]
            return [(*name, int(seq[end]), int(ts[end]), None, None)]
        following = np.searchsorted(times, times + limit, "right")
        end = np.arange(len(rows))
        for i in range(len(rows) - 1, -1, -1):
            if following[i] < len(rows):
                end[i] = end[following[i]]
        return [(*name, int(seq[rows[e]]), int(times[e]), int(seq[r]), int(t)) for e, r, t in zip(end, rows, times)]

    def run(batches):
        name, parts = None, []
        out = [*keys, "node_seq", "node_ts", "at_seq", "at_ts"]

        def close():
            found = lane(name, *(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 10_000]), kinds)], out)

        for batch in batches:
            kinds = [*(batch.schema.field(k).type for k in keys), *[pa.int64()] * 4]
            other, alone, ts = _fields(batch, keys)
            seq = batch.column("seq").to_numpy()
            bounds = [i for i in np.flatnonzero(other) if i == 0 or any(batch.column(k)[int(i)] != batch.column(k)[int(i) - 1] for k in keys)]
            for i, j in zip(bounds, [*bounds[1:], batch.num_rows]):
                here = tuple(batch.column(k)[int(i)].as_py() for k in keys)
                if here != name:
                    if parts:
                        yield from close()
                    name, parts = here, []
                elif parts and i == 0:  # goes on from the batch before
                    other[0] = batch.column("sender")[0].as_py() != sender or sender is None
                part = slice(int(i), int(j))
                parts.append((other[part], alone[part], ts[part], seq[part]))
            sender = batch.column("sender")[batch.num_rows - 1].as_py() if batch.num_rows else None
        if parts:
            yield from close()

    return run


def open_anchors(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(group, lane, seq, time in microseconds) of the anchor that is open where a lane begins, for the lanes that begin inside an island of one sender."""
    limit, keys = cfg.merge_seconds * 1_000_000, [key, LANE]
    alone = F.coalesce("is_sticker", F.lit(False)) | F.coalesce("is_image", F.lit(False))
    giant = once(messages.filter(F.col(LANE) > 0).select(key).distinct())  # fewer than all rows over the rows of a lane
    slim = once(messages.select(key, LANE, "seq", "sender", "is_sticker", "is_image", "ts").join(F.broadcast(giant), key, "left_semi"))
    edge = F.struct(F.col("sender").alias("sender"), alone.alias("alone"))
    lanes = slim.groupBy(*keys).agg(F.min_by(edge, "seq").alias("first"), F.max_by(edge, "seq").alias("last"), F.max("ts").alias("top"))
    last = F.lag("last").over(Window.partitionBy(key).orderBy(LANE))
    on = F.coalesce((last["sender"] == F.col("first.sender")) & ~last["alone"] & ~F.col("first.alone"), F.lit(False))
    lanes = once(lanes.withColumn("on", on))
    goes_on = {tuple(r) for r in lanes.filter("on").select(*keys).collect()}  # lanes of giant groups
    kind = messages.schema[key].dataType.simpleString()
    nodes = slim.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(_leaving(keys, limit, goes_on), f"{key} {kind}, {LANE} int, node_seq long, node_ts long, at_seq long, at_ts long")
    nodes = once(nodes)
    known = nodes.filter("at_seq is null").select(*keys, "node_seq", "node_ts")
    through = nodes.filter("at_seq is not null")
    open_lanes = through.groupBy(*keys).agg(F.max("at_ts").alias("top"))
    # the first later lane with a row beyond the limit, before the lane that decides for itself
    table = lanes.select(*keys).join(open_lanes, keys, "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(LANE).alias("lane"), "top"))).alias("_lanes"))
    after = F.filter("_lanes", lambda x: x["lane"] > F.col(LANE))
    stop = F.coalesce(F.get(F.filter(after, lambda x: x["top"].isNull()), F.lit(0))["lane"], F.lit((1 << 31) - 1))
    reach = F.get(F.filter(after, lambda x: (x["lane"] < stop) & (x["top"] > F.col("node_ts") + limit)), F.lit(0))["lane"]
    every = known.unionByName(through.select(*keys, "node_seq", "node_ts")).distinct()
    probes = every.join(F.broadcast(table), key).withColumn("to", reach).filter("to is not null").select(key, F.col(LANE).alias("from"), "node_seq", "node_ts", "to")
    met = probes.select(key, F.col("to").alias(LANE), (F.col("node_ts") + limit).alias("t"), F.lit(0).alias("kind"), F.struct("from", "node_seq").alias("probe"), F.lit(None).cast("struct<seq:bigint,ts:bigint>").alias("end"))
    met = met.unionByName(through.select(*keys, F.col("at_ts").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<from:int,node_seq:bigint>").alias("probe"), F.struct(F.col("node_seq").alias("seq"), F.col("node_ts").alias("ts")).alias("end")))
    later = Window.partitionBy(*keys).orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    jump = met.withColumn("end", F.last("end", ignorenulls=True).over(later)).filter("kind = 0")
    jump = once(jump.select(F.col(key).alias("group"), F.col("probe.from").alias("from"), F.col("probe.node_seq").alias("from_seq"), F.col(LANE).alias("to"), F.col("end.seq").alias("to_seq"), F.col("end.ts").alias("to_ts")))
    reached, rounds = known, int(lanes.groupBy(key).count().agg(F.max("count")).first()[0] or 0).bit_length()
    for _ in range(rounds):
        step = reached.join(jump, (F.col(key) == F.col("group")) & (F.col(LANE) == F.col("from")) & (F.col("node_seq") == F.col("from_seq")))
        reached = once(reached.unionByName(step.select(key, F.col("to").alias(LANE), F.col("to_seq").alias("node_seq"), F.col("to_ts").alias("node_ts"))).distinct())
        second = jump.select(*(F.col(c).alias(f"_{c}") for c in jump.columns))
        both = jump.join(second, (F.col("group") == F.col("_group")) & (F.col("to") == F.col("_from")) & (F.col("to_seq") == F.col("_from_seq")))
        jump = once(both.select("group", "from", "from_seq", F.col("_to").alias("to"), F.col("_to_seq").alias("to_seq"), F.col("_to_ts").alias("to_ts")))
    before = Window.partitionBy(key).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    left = lanes.select(*keys, "on").join(reached, keys, "left").withColumn("x", F.last(F.when(F.col("node_seq").isNotNull(), F.struct("node_seq", "node_ts")), ignorenulls=True).over(before))
    return left.filter("on").select(*keys, F.col("x.node_seq").alias("seq"), F.col("x.node_ts").alias("at"))


def merge_fragments(messages: DataFrame, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """Messages with their fragments' texts joined by blanks, and the other columns of the first; null senders are nobody's, so they do not merge."""
    keys, limit, incoming = by(messages, key), cfg.merge_seconds * 1_000_000, {}
    if LANE in messages.columns:
        messages = once(messages)
        incoming = {(r[0], r[1]): (r["seq"], r["at"]) for r in open_anchors(messages, cfg, key).collect()}  # one per lane of giant groups at most
    out = messages.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(_pass(keys, limit, incoming), messages.schema)
    if incoming:  # parts of a message that goes on over lanes
        rest = [c for c in messages.columns if c not in (key, "seq", "text")]
        parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(LANE).alias("at"), "text"))), lambda x: x["text"])
        out = out.groupBy(key, "seq").agg(F.min_by(F.struct(*rest), LANE).alias("x"), parts.alias("_parts")).select(key, "seq", "x.*", F.when(~F.exists("_parts", lambda t: t.isNull()), F.array_join("_parts", " ")).alias("text")).select(*messages.columns)
    return out.withColumn("text", F.when(F.col("is_sticker") | F.col("is_image"), F.col("text")).otherwise(strip(F.col("text"))))
