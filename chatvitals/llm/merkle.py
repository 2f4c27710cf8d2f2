"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Paragraphs are a text's lines with their line feeds; a section ends with the blank lines after it.  Leaves are a paragraph's sentences,
long ones cut after words that a hash picks, so that an edit moves the bounds near it only; together they are the text.  Inner
nodes digest their children's digests, a lone child's too, each level by a hash of its own.

The fingerprint is text: the root's digest, then the tree: `/` before a section and `,` before a paragraph, each with eight
hex digits of its digest and `=` if it has several children (else it is shown as its child is), and for each leaf eight hex digits, `.`, its length as a
base-36 number and `;`.  Equal texts have equal fingerprints; roots test equality (128 bits).

`differing` walks both trees down branches whose digests differ, aligned by digest, and names the leaves that only one has.
`likeness` is twice the characters of leaves that both trees hold, wherever they stand, over all characters (0 to 1; two empty texts: 1): branches
with equal digests count whole, and only what is left of the others is entered.

Null text counts as empty, the tree without sections; very long texts are trees of more nodes, in time linear in their length.  Rows are not merged; ties and repeated rows give equal fingerprints.  Empty tables
give no rows.  Columns of the input stay in `fingerprints`, but for one of the target's name; `against_next` drops others.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+\s*|\Z)", re.S)
LINE = re.compile(r"[^\n]*\n|[^\n]+")
LONG = 160


def _digest(data: bytes, level: bytes) -> bytes:
    """128 bits; each level has its own hash, so no text is the digest of another level's node."""
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


def leaves(paragraph: str) -> list[str]:
    out = []
    for sentence in SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            if sentence:
                out.append(sentence)
            continue
        start = size = 0
        words = sentence.split(" ")
        for k, word in enumerate(words):
            size += len(word) + 1
            if hashlib.blake2b(word.encode(), digest_size=1).digest()[0] < 32 and k + 1 < len(words) and size >= 32:
                out.append(" ".join(words[start : k + 1]) + " ")
                start, size = k + 1, 0
        out.append(" ".join(words[start:]))
    return [x for x in out if x]


_36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = _36[r] + out
        if not n:
            return out


class Node(NamedTuple):
    """A branch or leaf: first eight hex digits of its digest, characters, children."""

    digest: str
    size: int
    below: tuple


def _inner(children: list[Node], digests: list[bytes], level: bytes) -> tuple[Node, bytes]:
    whole = _digest(b"".join(digests), level)
    return Node(whole[:4].hex() if len(children) > 1 else children[0].digest, sum(c.size for c in children), tuple(children)), whole


def build(text: str) -> tuple[str, tuple[Node, ...]]:
    """Fingerprint and sections of a text."""
    sections, roots, here, digests, blank = [], [], [], [], False

    def close():
        node, whole = _inner(here, digests, b"section")
        sections.append(node)
        roots.append(whole)
        here.clear()
        digests.clear()

    for line in LINE.findall(text):
        if blank and here and not line.isspace():
            close()
        blank = line.isspace()
        below, found = [], []
        for leaf in leaves(line):
            d = _digest(leaf.encode(), b"leaf")
            found.append(d)
            below.append(Node(d[:4].hex(), len(leaf), ()))
        node, whole = _inner(below, found, b"paragraph")
        here.append(node)
        digests.append(whole)
    if here:
        close()
    return _digest(b"".join(roots), b"text").hex() + ":" + "".join(map(_shown, sections)), tuple(sections)


def _shown(section: Node) -> str:
    inner = lambda node: node.digest + "=" if len(node.below) > 1 else ""
    return "/" + inner(section) + "".join("," + inner(p) + "".join([f"{x.digest}.{_base36(x.size)};" for x in p.below]) for p in section.below)


def fingerprint(text: str) -> str:
    return build(text)[0]


_LEAF = re.compile(r"([0-9a-f]{8})\.([0-9a-z]+);")


def tree(mark: str) -> tuple[Node, ...]:
    """The sections that a fingerprint holds."""

    def branch(shown: str, children: list[Node]) -> Node:
        return Node(shown[:8] if shown[8:9] == "=" else children[0].digest, sum(c.size for c in children), tuple(children))

    def paragraph(shown: str) -> Node:
        return branch(shown, [Node(d, int(n, 36), ()) for d, n in _LEAF.findall(shown)])

    return tuple(branch(s, [paragraph(p) for p in s.split(",")[1:]]) for s in mark.partition(":")[2].split("/")[1:])


def shared(left: list[Node], right: list[Node], depth: int = 3) -> int:
    """Characters of the leaves that both lists of branches hold; depth: 3 for sections, 2 for paragraphs, 1 for leaves."""
    name = lambda x: (x.digest, x.size)
    both = Counter(map(name, left)) & Counter(map(name, right))
    total = sum(size * n for (_, size), n in both.items())
    if depth == 1 or not left or not right:
        return total

    def rest(nodes):
        spent, out = dict(both), []
        for x in nodes:
            if spent.get(name(x)):
                spent[name(x)] -= 1
            else:
                out += x.below
        return out

    return total + shared(rest(left), rest(right), depth - 1)


def alike(left: tuple[Node, ...], right: tuple[Node, ...]) -> float:
    total = sum(x.size for x in left) + sum(x.size for x in right)
    return 2 * shared(left, right) / total if total else 1.0


def likeness(a: str, b: str) -> float:
    """Twice the characters of shared leaves over all characters; a leaf counts as often as both hold it."""
    return 1.0 if a == b else alike(tree(a), tree(b))


def differing(a: str, b: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(section, paragraph, leaf) of the leaves that only a has, and of those that only b has; equal branches are not entered."""
    found: tuple[list, list] = [], []
    if a.partition(":")[0] == b.partition(":")[0]:
        return found

    def whole(side: int, node: Node, at: tuple) -> None:
        if not node.below:
            found[side].append(at)
        for k, x in enumerate(node.below):
            whole(side, x, (*at, k))

    def walk(left: tuple, right: tuple, at: tuple, beside: tuple) -> None:
        names = [[(x.digest, x.size) for x in side] for side in (left, right)]
        for kind, i, i2, j, j2 in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            many = min(i2 - i, j2 - j) if left[i:i2] and right[j:j2] and left[i].below else 0
            for k in range(many):  # changed in place
                walk(left[i + k].below, right[j + k].below, (*at, i + k), (*beside, j + k))
            for k in range(i + many, i2):
                whole(0, left[k], (*at, k))
            for k in range(j + many, j2):
                whole(1, right[k], (*beside, k))

    walk(tree(a), tree(b), (), ())
    return found


def fingerprints(df: DataFrame, text: str = "text", target: str = "fingerprint") -> DataFrame:
    """Adds each text's fingerprint; other columns stay."""
    kept = [c for c in df.columns if c != target]

    def run(batches):
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            marks = [fingerprint(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(marks, pa.large_string())], [*kept, target])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(target, T.StringType())]))


COMPARED = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))]
)
#: both fingerprints in one column, so that what they share is stored once
_HELD = T.StructType([f for f in COMPARED.fields if "fingerprint" not in f.name] + [T.StructField("both", T.StringType())])
_EDGES = T.StructType([*_HELD.fields, T.StructField("place", T.LongType()), T.StructField("side", T.LongType()), T.StructField("text", T.StringType())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ARROW_EDGES = pa.schema([*(f for f in _ARROW if "fingerprint" not in f.name), ("both", pa.large_string()), ("place", pa.int64()), ("side", pa.int64()), ("text", pa.large_string())])


def compare(doc_id, text: str, built: tuple, following: str, following_tree: tuple) -> dict:
    n = len(text)
    half = n // 2
    edited = text[: n - half] + following[:half]
    edited_mark, edited_tree = build(edited)
    return {"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": built[0], "edited_fingerprint": edited_mark, "near_edited": alike(built[1], edited_tree), "near_next": alike(built[1], following_tree)}


def against_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited version and the next document's text, by descending doc_id (ties by text).

    One range-partitioned, sorted pass: neighbours meet inside a partition; each partition's first and last document come
    out as edge rows, two a partition, and are paired afterwards.  A single document is its own next."""
    from .common import written

    ordered = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches):
        from pyspark import TaskContext

        place, before = TaskContext.get().partitionId(), None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    built = build(t)
                    if before is None:
                        out.append({"doc_id": d, "place": place, "side": 0, "text": t})
                    else:
                        row = compare(*before, t, built[1])
                        out.append(row | {"both": f"{row.pop('fingerprint')}|{row.pop('edited_fingerprint')}"})
                    before = d, t, built
                yield pa.RecordBatch.from_pylist(out, _ARROW_EDGES)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "place": place, "side": 1, "text": before[1]}], _ARROW_EDGES)

    whole = written(ordered.mapInArrow(run, _EDGES), "merkle")
    parts = {"fingerprint": F.split_part("both", F.lit("|"), F.lit(1)), "edited_fingerprint": F.split_part("both", F.lit("|"), F.lit(2))}
    done = whole.filter("place is null").withColumns(parts).select(*COMPARED.fieldNames())
    firsts = whole.filter("side = 0").select("place", F.col("text").alias("following"))
    lasts = whole.filter("side = 1").select("place", "doc_id", "text")
    # two rows a partition: the partitions in use, each with the one after it, the last with the first
    used = sorted(r.place for r in firsts.select("place").collect())
    if not used:
        return done
    pairs = df.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1])), "place long, after long")
    edges = lasts.join(pairs, "place").join(firsts.withColumnRenamed("place", "after"), "after").select("doc_id", "text", "following")

    def pair(batches):
        for batch in batches:
            for row in (batch.slice(at, 1) for at in range(batch.num_rows)):  # texts of any length
                r = row.to_pylist()[0]
                yield pa.RecordBatch.from_pylist([compare(r["doc_id"], r["text"], build(r["text"]), r["following"], build(r["following"])[1])], _ARROW)

    return done.unionByName(edges.mapInArrow(pair, COMPARED))


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return against_next(read(spark, sf_dir, "documents"))
