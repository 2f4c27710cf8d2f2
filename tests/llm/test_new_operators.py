"""Manifest, secrets and hard negatives against brute force, with odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatvitals.llm import hard_negatives, manifest, secret_scan


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, p):
    for level in levels[:-1]:
        first = p - p % 16
        yield "".join(level[first:p]), "".join(level[p + 1 : first + 16])
        p //= 16


def _manifest(rows):
    groups = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _leaf(r), _leaf((*r[:4], _lower(r[4]))) if changed else _leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(groups[s]), None) for s in names]
    trees = [(g, _tree([x[2] for x in g])) for g, _ in trees]
    top = _tree([levels[-1][0] for _, levels in trees])
    for k, (group, levels) in enumerate(trees):
        for p, (there, key, leaf, changed) in enumerate(group):
            path = [*_path(levels, p), *_path(top, k)]
            folded = changed
            for before, after in path:
                folded = _h(before + folded + after)
            yield key if there else None, leaf, levels[-1][0], top[-1][0], _h("".join(b + a for b, a in path)), folded, folded == top[-1][0]


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [256, 257, 2], [4113, *[1 + i % 3 for i in range(300)]]], ids=str)
def test_manifest(spark, tmp_path, sizes):
    rnd = random.Random(1)
    rows = [(rnd.randrange(10**6), None if s == 1 else f"s{s}é", rnd.choice(["en", None]), n, rnd.choice(["Ab é", "", None, "x" * 3000])) for s, n in enumerate(sizes) for _ in range(n)]
    rows += [(None, "s0é", None, None, "A"), (None, "s0é", None, None, "B"), rows[0], rows[0]] if len(rows) > 20 else []
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.select("*", F.lit(1).alias("place"), F.lit(2).alias("digest")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op11(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _manifest(rows)))


def test_manifest_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.op11(spark, str(tmp_path)).count() == 0


def test_manifest_stores_every_second_level(spark):
    rows = spark.range(5000).select(F.lit(True).alias("known"), F.lit("g").alias("name"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("string").alias("changed"), F.col("id").alias("salt"))
    made = manifest.build(rows)
    assert [x.count() for x in made.levels] == [20, 1] and [x.count() for x in made.tops] == [1]


SAID = ["password", "Passwd", "SECRET", "token", "apikey", "api_key", "API_KEY", '"', "'", " ", "  ", ":", "=", "abc", "AKIA", "AKIAABCDEFGHIJKL12", "0f3a", "deadbeef" * 4, "deadbeef" * 5, "é", "ſecret", "密", "x.y-z/1+2=", "\n", "-----BEGIN ", "RSA PRIVATE KEY-----", "gh", "ghp_", "A1b2" * 9, "xoxb-", "eyJ", ".", "_"]


def _secrets(text):
    found = []
    for i, r in enumerate(secret_scan.RULES):
        found += [(m.start(), i, r.name, m.end()) for m in re.finditer(r.pattern, text or "", re.I | re.A if r.fold else 0) if len(m[r.group]) >= r.least]
    return sorted(found)


def test_secrets(spark, tmp_path):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(SAID) for _ in range(rnd.randrange(1, 30))) for _ in range(1500)]
    texts += [None, "", "secret: secret: abcdefgh1", "token=" * 30_000, "token:token:abcdefgh", "x" * 200_000 + " password = hunter2hunter2"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (3, texts[3]), (3, texts[3]), (3, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.select("*", F.lit(0).alias("key"), F.lit("").alias("spans"), F.lit("").alias("who")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    shown = lambda x: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in x)
    want = []
    for d, t in rows:
        x = _secrets(t)
        want.append((d, *(sum(y[1] == i for y in x) for i in range(3)), _h(shown([y for y in x if y[1] < 3])), shown(x)))
    got = secret_scan.op12(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(bool(w[-1]) for w in want) > 300


def test_secrets_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert secret_scan.op12(spark, str(tmp_path)).count() == 0


def test_trigram_queries():
    sets = lambda p: [sorted(b) for b in secret_scan.trigram_query(p)]
    assert sets("abcd") == [["abc", "bcd"]] and sets("ab") == [] and sets("abc|xy") == [] and sets("abc|xyz") == [["abc"], ["xyz"]]
    assert sets("abc(d)?") == [["abc"]] and sets("ab[cC]d*") == [["abc"]] and sets("(abc)+x") == [["abc"]] and sets("[0-9a-f]{32,}") == []
    assert sets("abc.xyz") == [["abc", "xyz"]] and sets("(ab){2}") == [["aba", "bab"]]


@pytest.mark.parametrize("pattern", ["(foo|ba[rz])_?key", "b[ac]{1,2}d+", "x.*yzz|(?:qrs)?tuv", r"no\x20*way[!?]"])
def test_every_match_satisfies_its_query(pattern):
    rnd, met = random.Random(3), 0
    for _ in range(20_000):
        text = "".join(rnd.choice(["foo", "bar", "baz", "_", "key", "a", "b", "c", "d", "ef", "x", "yzz", "qrs", "tuv", "no", " ", "way", "!"]) for _ in range(rnd.randrange(2, 8)))
        m = re.search(pattern, text)
        if m:
            met += 1
            grams = {m[0][i : i + 3] for i in range(len(m[0]) - 2)}
            assert any(b <= grams for b in secret_scan.trigram_query(pattern)) or not secret_scan.trigram_query(pattern)
    assert met > 10


def test_a_rule_of_the_callers_own_scans_fully(spark):
    df = spark.createDataFrame([(1, "a1b22"), (2, "none")], "id int, said string")
    rules = (secret_scan.Rule("number", r"[0-9]+"), secret_scan.Rule("word", "none"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.spans(df, rules, "id", "said").collect()}
    assert got == {1: [("number", 1, 2), ("number", 3, 5)], 2: [("word", 0, 4)]}


def _mined(rows, anchors, k=5):
    """By plain loops; rows: (id, label, integer vector)."""
    first = {}
    for i, label, v in rows:
        if anchors(i):
            first[i] = min(first.get(i, (v, label)), (v, label))
    for a, (v, label) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for score, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and -80 * score <= -100 * x[0] <= -100 * score][:k]
            yield from ((a, p, n + 1, i, -score, -s) for n, (s, i, _) in enumerate(fit))


@pytest.mark.parametrize("kind", ["random", "long", "clustered", "ties"])
def test_hard_negatives(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 12)) / 3
    if kind == "long":  # lengths differ widely, some products beyond 2**53
        v *= np.exp(rng.uniform(-3, 14, (600, 1)))
    if kind == "clustered":
        v = v[rng.integers(0, 6, 600)] * 3 + v / 8
    if kind == "ties":
        v = np.round(v)
        v[200:400] = v[0]
    rows = [(int(i), int(rng.integers(0, 4)), x.tolist()) for i, x in enumerate(v)]
    if kind == "ties":
        rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (20, 3, rows[9][2]), (40, 2, rows[40][2]), (7, None, rows[7][2]), (None, 1, rows[7][2]), (8, 1, None), (9, 1, [None] * 12), (11, 1, [float("nan")] * 12), (12, 2, [float("inf")] * 12), (13, 0, []), (60, 0, [1.0, 2.0]), (80, 0, [0.0, 0.0]), (81, 0, [1.0, 1.0]), (82, 1, [1.0, 0.5]), (83, 1, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("*", F.lit(0).alias("d"), F.lit("").alias("block")).repartition(5)
    usable = [(i, label, tuple(int(np.floor(256 * x)) for x in w)) for i, label, w in rows if i is not None and label is not None and w and all(x is not None and np.isfinite(x) for x in w)]
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(_mined(usable, lambda i: i % 20 == 0))


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 20 == 0).count() == 0


def test_feasible_ranges_hold_and_prune():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 8))
    v[2000:] = v[0] + rng.standard_normal((2000, 8)) / 6
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    for t in (0.2, 0.6, 0.95):
        low, high = hard_negatives.feasible(v[0], np.full(8, t))
        near = v[v @ v[0] >= t]
        assert ((near >= low) & (near <= high)).all()
    length = np.ones(4000)
    bucket = hard_negatives.Bucket(np.arange(4000), np.zeros(4000, int), (v * 1e6).astype(np.int64), length * 1e6)
    a = hard_negatives.Anchors(np.array([0]), np.array([0]), bucket.v[:1], np.array([[int(0.97e12)]]), np.array([[1 << 62]]), True, 5)
    whole, few = a.chosen(bucket, np.array([0]), np.array([0.97]))
    assert not len(whole) and (v[few[0][1]] @ v[0] >= 0.97).sum() == (v @ v[0] >= 0.97).sum() and len(few[0][1]) < 2010
