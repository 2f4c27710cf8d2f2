"""Suffix dedup, Jaccard groups and the pipeline against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatvitals.llm import jaccard, suffix_dedup


def _texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 25)))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randrange(2), rnd.choice(shared)[rnd.randrange(20) :])
        out.append(" ".join(parts))
        if rnd.random() < 0.3:
            t = rnd.choice(out)
            k = rnd.randrange(len(t) + 1)
            out.append(t[:k] + rnd.choice(["", "zz ", "q"]) + t[k:])
    return out + [None, "", "", "ab" * 300, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


@pytest.mark.parametrize("length", [12, 40])
def test_repeats(spark, length):
    texts = _texts(length)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, spans int").repartition(4)
    data = [(t or "").encode() for t in texts] + [(texts[0] or "").encode()]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for r in suffix_dedup.repeats(df, length).collect():
        b = data[r["doc_id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g) and r["n_bytes"] == len(b)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == sum(gone)
        assert len(r["spans"]) == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    assert suffix_dedup.repeats(df.filter("false"), length).count() == 0


def _first_copies(rows, length):
    """Bytes left of (doc_id, text) rows where the first of equal windows stays, window by window."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    seen, count = {}, Counter()
    for n, (*_, t) in enumerate(order):
        b = t.encode()
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] += 1
            seen.setdefault(b[k : k + length], (n, k))
    out = {}
    for n, (null, i, t) in enumerate(order):
        b = t.encode()
        gone, firm = bytearray(len(b)), bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if count[w] > 1:
                (firm if seen[w] == (n, k) else gone)[k : k + length] = b"\1" * length
        out[None if null else i] = bytes(x for x, g, f in zip(b, gone, firm) if f or not g)
    return out


@pytest.mark.parametrize("length, bucket", [(12, 2_000_000), (40, 2_000_000), (12, 200)])
def test_first_copies_stay(spark, monkeypatch, length, bucket):
    compared = suffix_dedup.compared
    monkeypatch.setattr(suffix_dedup, "compared", lambda table: compared(table, bucket))
    texts = _texts(length + 1)
    rows = [(i * 7919 % 1009 - 3, t) for i, t in enumerate(texts)] + [(None, "xyz " + texts[3]), (-3, texts[0])]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, keep_first=True).collect()
    left = _first_copies(rows, length)
    assert len(got) == len(rows) and all(bytes(r["kept"]) == left[r["doc_id"]] for r in got)
    kept = b"\0".join(bytes(r["kept"]) for r in got)
    data = [t.encode() for _, t in set(rows) if t]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    assert all(w in kept for w, n in count.items() if n > 1)  # every repeated string stays once at least


def test_pipeline_keeps_one_copy_of_a_passage(spark, sf):
    passage = " ".join(f"word{i}" for i in range(60))
    other = _words("o", 70)
    rows = [(9, _words("a") + " " + passage), (4, passage + " " + _words("b")), (6, passage), (2, other), (None, other + " end"), (5, _words("c")), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    done = corpus_pipeline.cut_repeats(spark, df, sf)
    got = {r["doc_id"]: r for r in done.collect()}
    assert done.columns == df.columns and len(got) == len(rows)
    texts = {i: r["text"] for i, r in got.items()}
    assert [i for i, t in texts.items() if t and passage in t] == [4] and texts[2] == other and texts[4] == rows[1][1] and texts[6] == ""
    assert texts[9] == rows[0][1][: -len(passage)] and texts[None] == " end" and (texts[5], texts[7], texts[8]) == (rows[5][1], None, "")


def test_chance_neighbours_do_not_keep_a_copy(spark, sf):
    """Copies that share a byte on either side with each other, but not with the first copy, still go; so do all but one of them."""
    passage = " ".join(f"word{i}" for i in range(45))
    own = lambda c: c + "".join(f"{k}{c}" for k in range(70))
    rows = [(1, own("a") + "<" + passage + ">" + own("b"))] + [(i, own(c) + "(" + passage + ")" + own(d)) for i, c, d in ((2, "c", "d"), (3, "e", "f"), (4, "g", "h"))]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    assert 200 < len(passage) < 398
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, df, sf).collect()}
    assert got[1] == rows[0][1]
    assert got[2] == rows[1][1].replace(passage, "") and [got[i] for i in (3, 4)] == [own("e") + own("f"), own("g") + own("h")]


def _weighed(rows, length):
    """Bytes left of (doc_id, text) rows where the longest run of windows over a byte decides (a first copy at a tie)."""
    seen, count = {}, Counter()
    data = {i: (t or "").encode() for i, t in sorted(rows)}
    for i, b in data.items():
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] += 1
            seen.setdefault(b[k : k + length], (i, k))
    out = {}
    for i, b in data.items():
        kinds = ["" if count[b[k : k + length]] < 2 else "f" if seen[b[k : k + length]] == (i, k) else "g" for k in range(len(b) - length + 1)]
        runs, at = [], 0
        for kind, run in itertools.groupby(kinds):
            n = len(list(run))
            runs.append((kind, at, at + n))
            at += n
        left = []
        for k, x in enumerate(b):
            over = [(s, e) for kind, s, e in runs if kind == "g" and s <= k < e + length - 1]
            firm = [(s, e) for kind, s, e in runs if kind == "f" and s <= k < e + length - 1]
            loses = lambda g: not any(e - s >= g[1] - g[0] or (e == g[0] and seen[b[e : e + length]][0] == i and s <= seen[b[e : e + length]][1] < e) for s, e in firm)  # noqa: B023, E731
            if not any(loses(g) for g in over):
                left.append(x)
        out[i] = bytes(left)
    return out


@pytest.mark.parametrize("length", [12, 40])
def test_longer_runs_win(spark, length):
    rows = list(enumerate(_texts(length + 2)))
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, keep_first=True, longer_wins=True).collect()
    want = _weighed(rows, length)
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want
    assert want[len(rows) - 1][:length] == b"a" * length  # a text that repeats itself keeps its first window
    kept = {w for b in want.values() for w in b}
    assert kept == {w for _, t in rows for w in (t or "").encode()}
    assert want != _first_copies(rows, length)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 20000), rng.integers(0, 50, 20000), rng.integers(-9, 9, 20000), rng.permutation(20000)]
    order = suffix_dedup.multikey_quicksort(columns, small=16)
    assert (order == np.lexsort(columns[::-1])).all()


def _groups(texts, n, num, den):
    sets = []
    for t in texts:
        w = jaccard_words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def jaccard_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("crowd", [2048, 8])
def test_jaccard(spark, crowd):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyz")
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(120):  # a chain of near copies, so that components are larger than links
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(rnd.randrange(12))) for _ in range(60)]
    texts += [texts[0].upper(), None, "", "  ", "One", "one ", "a b", "a b c", "shared " * 30, "shared " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df, 4, 85, 100, crowd=crowd).collect()}
    assert got == _groups(texts, 4, 85, 100)


def test_jaccard_small_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.groups(df).collect()} == {(1, 0, 1), (2, 0, 2)}
    assert jaccard.groups(df.filter("false")).count() == 0


def _words(tag, n=100, **changed):
    return " ".join(changed.get(f"{tag}{i}", f"{tag}{i}") for i in range(n))


def test_jaccard_null_ids_in_a_chain(spark):
    link, far = _words("a", a10="x"), _words("a", a10="x", a60="y")
    rows = [(7, _words("a")), (None, link), (9, far), (None, link), (None, _words("b")), (None, _words("b", b20="z")), (8, _words("c")), (8, _words("d")), (3, _words("d", d5="q"))]
    sets = {t: {tuple(t.split()[i : i + 4]) for i in range(97)} for _, t in rows}
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert like(rows[0][1], far) < 0.9 < min(like(rows[0][1], link), like(link, far))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.groups(df, 4, 90, 100).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (-1, 7), (3, 3), (7, 7), (8, 3), (8, 8), (9, 7)]
    labels = jaccard.groups(df, 4, 90, 100, labels_too=True).filter("component_id is null").select("label").distinct()
    assert labels.count() == 1


def test_near_copies_of_null_and_repeated_ids(spark, sf):
    rows = [(1, _words("a")), (5, _words("a", a3="x")), (5, _words("b")), (None, _words("c")), (None, _words("d")), (None, _words("d", d9="x")), (None, _words("a", a7="x")), (6, _words("e")), (6, _words("e")), (6, " "), (7, None), (None, ""), (1, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect()]
    d = [r for r in got if r in (rows[4], rows[5])]
    assert len(d) == 1
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=key) == sorted([rows[0], rows[2], rows[3], *d, rows[7], *rows[9:]], key=key)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    ids = sorted(rows)
    groups = _groups([rows[i]["text"] for i in ids], 5, 4, 5)
    assert near.columns == docs.columns
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == {ids[i] for i, (n, root) in groups.items() if not n or root == i}
    cut = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()}
    assert cut.keys() == rows.keys()
    size = corpus_pipeline.PASSAGE_BYTES
    data = {i: (r["text"] or "").encode() for i, r in rows.items()}
    left = _first_copies([(i, r["text"]) for i, r in rows.items()], size)
    for i, b in data.items():
        if left[i] == b:
            assert cut[i] == rows[i]
        else:
            assert len(cut[i]["text"].encode()) < len(b) and cut[i]["n_chars"] == len(cut[i]["text"])
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() > 0.8 * len(rows)


def _gone(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + size] for b in data for k in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append(gone)
    return data, out


def test_suffix_dedup_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in suffix_dedup.op7(spark, sf).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    for r, b, gone in zip(rows, *_gone([r["text"] for r in rows], 400)):
        left, mine = bytes(x for x, g in zip(b, gone) if not g), got[r["doc_id"]]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (mine["n_bytes"], mine["n_removed"], mine["n_spans"], mine["kept_sha256"]) == (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    assert sum(r["n_removed"] > 0 for r in got.values()) > 10


def test_jaccard_query(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(rows)
    want = {ids[i]: (n, ids[root]) for i, (n, root) in _groups([rows[i] for i in ids], 4, 85, 100).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op9(spark, sf).collect()} == want


def test_long_texts(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, "head " + long), (3, long[:200_000]), (4, "é" * 1000), (5, "x" + "é" * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.repeats(df, 400).collect()}
    assert got == {1: b"", 2: b"head ", 3: b"", 4: b"", 5: b"x"}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_repeats_keep_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "a" * 60, 7, "f"), (2, "b", 8, None)], "doc_id long, text string, uid int, found string").selectExpr("*", "1 as bucket", "2 as kept")
    out = suffix_dedup.repeats(df, 40)
    assert out.columns == ["doc_id", "text", "uid", "found", "bucket", "n_bytes", "spans", "kept", "kept_text"]
    assert sorted((r["doc_id"], r["uid"], r["found"], r["bucket"], r["kept_text"]) for r in out.collect()) == [(1, 7, "f", 1, ""), (2, 8, None, 1, "b")]


_CLASHING = ("score", "predicted", "kept", "spans", "n_bytes", "kept_text", "uid", "found", "whole_row", "row_key", "row", "label", "bucket", "_bucket", "n_shingles", "component_id", "length", "place")


def test_stages_keep_clashing_columns_and_marks(spark, sf):
    passage = " ".join(f"véry{k}" for k in range(60))
    texts = ["start � here " + passage + " end �", "other � " + passage, None, "", "plain text of its own", "é" * 300, "xé" + "é" * 300]
    docs = spark.createDataFrame([(i, t, len(t or ""), f"keep{i}") for i, t in enumerate(texts)] + [(9, texts[4], 21, "again"), (None, "no id", 5, "none")], "doc_id long, text string, n_chars long, mine string")
    docs = docs.withColumns({c: docs["mine"] for c in _CLASHING}).repartition(3)
    rows = {(r["doc_id"], r["mine"]): r for r in docs.collect()}
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats):
        out = stage(spark, docs, sf)
        assert out.schema.fieldNames() == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert all(r[c] == r["mine"] for r in got for c in _CLASHING)
        if stage is not corpus_pipeline.cut_repeats:
            assert {tuple(r) for r in got} <= {tuple(r) for r in rows.values()}
            assert len(got) == len(rows) - (2 if stage is corpus_pipeline.drop_near_copies else 0)
        else:
            assert len(got) == len(rows)
            left = _first_copies([(r["doc_id"], r["text"]) for r in rows.values()], corpus_pipeline.PASSAGE_BYTES)
            assert sum(passage in (r["text"] or "") for r in got) == 1
            for r in rows.values():
                new = next(x for x in got if (x["doc_id"], x["mine"]) == (r["doc_id"], r["mine"]))
                if left[r["doc_id"]] == (r["text"] or "").encode():
                    assert tuple(new) == tuple(r)
                else:
                    assert new["n_chars"] == len(new["text"]) and new["text"].count("�") == r["text"].count("�")
        assert stage(spark, docs.filter("false"), sf).count() == 0
    assert corpus_pipeline.pack(spark, docs.filter("false"), sf).count() == 0
    assert corpus_pipeline.pack(spark, docs, sf).select(F.sum("length")).first()[0] > len(rows)


def test_pipeline_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    whole = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert whole(got) == whole(corpus_pipeline.pack(spark, docs, sf))
