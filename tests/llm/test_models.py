"""Toxicity, suffix tree, nearest neighbours, packing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatvitals.llm import packing, rotated_codes, suffix_lm, toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_is_levenshtein():
    rnd, terms = random.Random(4), [("hello", False), ("help", True), ("abcdefghi", False), ("abcab", True)]
    m = toxicity.Automaton(terms)
    for _ in range(4000):
        w = "".join(rnd.choice("helopabc") for _ in range(rnd.randrange(12)))
        if rnd.random() < 0.7:
            w = list(rnd.choice(terms)[0])
            for _ in range(rnd.randrange(3)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice("hxlb")) if rnd.random() < 0.5 else w.pop(rnd.randrange(len(w)))
            w = "".join(w) + rnd.choice(["", "zz"])
        want = {}
        for n, (t, stem) in enumerate(terms):
            e = min(_distance(t, w)) if stem else _distance(t, w)[-1]
            if e <= m.allowed[n]:
                want[n] = e
        assert m.match(w) == want, w


def _labelled(spark, n=400):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            text.insert(3, rnd.choice(["grumbler", "nastyface"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    assert {t for t, _ in model.terms} == {"grumbler", "nastyface"}
    assert model.score("you Grumbler!") > 0.5 and model.score("you grumblr") > 0.5 and model.score("w1 w2") < 0.5
    assert model.score('they said "grumblr" to') < model.score("you grumblr") 
    odd = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "grumbler " * 9000, 5)], "doc_id long, text string, score int")
    out = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in sorted(out, key=lambda r: r["text"] or "")] == [0, 0, 1] and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.fit(docs.filter("false"), labels.filter("false"))
    assert toxicity.score(docs, empty).filter("predicted = 1").count() == 0


def test_toxicity_learns_to_leave_quotes_alone(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(20)]
        if i % 3 == 0:
            text[5:5] = ["grumbler"]
        elif i % 3 == 1:
            text[5:5] = ["she", "wrote", "«grumbler»"]
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert min(w for (_, _, mode), w in model.weights.items() if mode == toxicity.QUOTED) < 0
    assert model.score("you grumbler w1") > 0.5 > model.score("w1 she wrote «grumbler» w2") and model.score("w1") < 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "grumbler"), (2, "grumbler"), (None, "grumblerr")], "doc_id long, text string")
    assert sorted(r["predicted"] for r in toxicity.score(odd, model).collect()) == [0, 0, 1, 1, 1]
    assert toxicity.score(odd.filter("false"), model).count() == 0


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op10(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def _suffix_scores(train, texts, depth=3, ratio=1.1, gain=2.0, least=3):
    """Base and full log10 scores and the longest retained context, by dictionaries."""
    rows = [[None, *_tokens(x)] for x in train]  # a document begins after an end
    grams = [Counter(tuple(w[i : i + m]) for w in rows for i in range(len(w) - m + 1)) for m in range(1, depth + 2)]
    c = Counter(t for w in rows for t in w[1:])
    total, v = sum(c.values()), len(c)
    trees: list[dict] = []

    def p(context, s):
        for k in range(min(len(trees), len(context)), 0, -1):
            if context[-k:] in trees[k - 1]:
                kept, factor = trees[k - 1][context[-k:]]
                return kept[s] if s in kept else p(context[-k:][1:], s) * factor
        return (c[s] + 1) / (total + v + 1)

    for k in range(1, depth + 1):
        behind = {}
        for g, n in grams[k].items():
            if n >= least:
                behind.setdefault(g[:-1], []).append((g[-1], n))
        held = {}
        for context, found in behind.items():
            if k > 1 and context[1:] not in trees[-1]:
                continue
            all_ = c[context[0]] if k == 1 else grams[k - 1][context]
            kinds = len(found) + all_ - sum(n for _, n in found)
            kept = {}
            for s, n in found:
                below = p(context[1:], s)
                q = (n + kinds * below) / (all_ + kinds)
                if q >= ratio * below or q * ratio <= below:
                    kept[s] = n, q, below
            if sum(n * math.log(q / b) for n, q, b in kept.values()) > gain * len(kept):
                held[context] = {s: q for s, (_, q, _) in kept.items()}, max(1 - sum(q for _, q, _ in kept.values()), 1e-9) / max(1 - sum(b for _, _, b in kept.values()), 1e-9)
        if not held:
            break
        trees.append(held)
    # behind every retained context the probabilities of all words and of an unknown one sum to 1
    for held in trees:
        for context in list(held)[:20]:
            assert sum(p(context, s) for s in [*c, "never seen"]) == pytest.approx(1)
    out = []
    for x in texts:
        w = [None, *_tokens(x)]
        out.append((sum(math.log10((c[t] + 1) / (total + v + 1)) for t in w[1:]), sum(math.log10(p(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(1, len(w)))))
    return out, len(trees)


@pytest.mark.parametrize("depth,held", [(3, 1_000_000), (3, 10), (1, 10), (5, 300)])
def test_suffix_lm_is_the_whole_tree(spark, depth, held):
    rnd = random.Random(8)
    common = [f"w{i}" for i in range(40)]
    phrases = [[f"{x}{i}" for i in range(7)] for x in "pqr"] + [["a", "b", "c", x, "b", "c", y] for x, y in ("de", "ed", "ff")]
    phrases += [["s1", "u", "v", "e1"], ["s2", "u", "v", "e2"], ["s3", "u", "m", "v", "e3"], ["s4", "u", "m", "v", "e4"]]
    texts = [" ".join(t for _ in range(rnd.randrange(1, 25)) for t in ([rnd.choice(common)] if rnd.random() < 0.8 else rnd.choice(phrases))) for _ in range(400)]
    texts += ["once seen rare words", "here once seen rare words", None, "", "unseen p1 p2 p3 words", "P1 \x0b\u00c4\u00a0x p2", "x" * 70000, "w1 w2 " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [x for i, x in enumerate(texts) if (i % 5 or i > 399) and i < 404]
    want, longest = _suffix_scores(train, texts, depth)
    model = suffix_lm.fit(df.filter("(doc_id % 5 > 0 or doc_id > 399) and doc_id < 404").select("text"), depth=depth, held=held)
    assert model.depth == longest >= min(depth, 3)
    c = Counter(t for x in train for t in _tokens(x))
    got = {r["doc_id"]: r for r in suffix_lm.score(df, model).collect()}
    for i, (base, score) in enumerate(want):
        w, r = _tokens(texts[i]), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[t] > 0 for t in w), sum(c.values()))
        assert (r["base_score"], r["score"]) == (pytest.approx(base), pytest.approx(score))


def test_suffix_lm_query(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    want, _ = _suffix_scores([t for i, t in rows.items() if i not in held], list(rows.values()))
    got = {r["doc_id"]: r for r in suffix_lm.op3(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for i, (base, score) in zip(rows, want):
        r = got[i]
        assert r["held_out"] == (i in held) and (r["base_score"], r["score"]) == (pytest.approx(base), pytest.approx(score))
    gain = lambda ids: sum(got[i]["score"] - got[i]["base_score"] for i in ids) / sum(got[i]["n_tokens"] for i in ids)
    assert gain(held) > 0.02 and gain(set(rows) - held) > gain(held)


def test_dealt_rows_come_in_one_order(spark, sf):
    """However the blocks of a shuffle arrive, a task sees its rows in the same order."""
    from chatvitals.llm.common import read

    docs = read(spark, sf, "documents", ("doc_id", "text"), ordered=True)
    held = docs.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.xxhash64("doc_id", "text").alias("h"), "doc_id").collect()
    assert len({r["p"] for r in held}) > 1
    for p in {r["p"] for r in held}:
        mine = [(r["h"], r["doc_id"]) for r in sorted(held, key=lambda r: r["i"]) if r["p"] == p]
        assert mine == sorted(mine)


def test_suffix_lm_grows_with_its_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c"))
    held = docs.filter("c % 7 = 2").select("text")
    gains = []
    for part in ("c % 7 > 4", "c % 7 <> 2"):
        model = suffix_lm.fit(docs.filter(part).select("text"))
        r = suffix_lm.score(held, model).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        gains.append((r[0] - r[1]) / r[2])
    assert 0.05 < gains[0] < gains[1]


def test_suffix_lm_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", 1, "x"), (2, None, 2, "y"), (2, None, 2, "y")], "doc_id long, text string, uid int, score string").selectExpr("*", "1 as known", "2 as base", "3 as part", "4 as times", "5 as row", "6 as `all`")
    model = suffix_lm.fit(df.filter("false").select("text"))
    out = suffix_lm.score(df, model)
    assert out.columns == ["doc_id", "uid", "known", "base", "part", "times", "row", "all", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["score"], r["uid"], r["times"]) for r in out.collect()) == [(1, 3, 0, 0.0, 1, 4), (2, 1, 0, 0.0, 2, 4), (2, 1, 0, 0.0, 2, 4)]
    model = suffix_lm.fit(df.select("text"))
    assert suffix_lm.score(df.filter("false"), model).count() == 0


def test_words_do_not_span_texts():
    import pyarrow as pa

    (first, hashes, row, place), = suffix_lm.tokens(pa.array(["ab", "cd e", None, "", "ab"]))
    assert first == 0 and row.tolist() == [0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4] and place.tolist() == [0, 1, 2, 0, 1, 2, 3, 0, 1, 0, 1, 0, 1, 2]
    assert hashes[1] == hashes[12] != hashes[4] and (hashes[[0, 2, 7, 8]] == suffix_lm.END).all()


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(8))  # many begin at the same slot
    t = suffix_lm.Lookup(keys, np.arange(len(keys)) + 1.0)
    hit, value = t.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert hit.tolist() == [True] * len(keys) + [False] * len(keys) and value.tolist() == [*range(1, len(keys) + 1), *[0] * len(keys)]


def test_nearest(spark):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((600, 24))
    m[100:300] = m[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [float("inf")] + [0.0] * 23), (780, [None] + [1.0] * 23), (800, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = rotated_codes.nearest(df, F.col("vec_id") % 20 == 0, 10, block=128, query_block=16).collect()
    assert {r["query_id"] for r in found} == set(range(0, 600, 20))  # the vector of one dimension is alone in its space
    out = [r for r in found if r["query_id"] < 600]
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        scores = m @ m[q]
        assert [x[0] for x in mine] == list(range(1, 11))
        assert all(s == pytest.approx(scores[i]) for _, i, s in mine)
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(scores, 9))) if i != q][:10]
        hits += len({i for _, i, _ in mine} & set(order))
    assert hits >= 0.9 * 300
    two = df.unionByName(spark.createDataFrame([(820, [2.0]), (821, [3e200])], "vec_id long, embedding array<double>"))
    alone = {(r["query_id"], r["vec_id"]): r["score"] for r in rotated_codes.nearest(two.filter("size(embedding) = 1"), F.col("vec_id") % 20 == 0).collect()}
    assert alone == {(800, 820): 2.0, (800, 821): 3e200, (820, 800): 2.0, (820, 821): 6e200}
    assert rotated_codes.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert rotated_codes.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_nearest_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in rotated_codes.op6(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = m @ m[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(s == pytest.approx(scores[ids == i][0], abs=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits >= 0.97 * 20 * len(got)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    share = rotated_codes.nearest(table, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.max("reranked").alias("n")).agg(F.avg("n")).first()[0] / len(rows)
    assert share < 0.1


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rnd = random.Random(seed)
    lengths = [min(256, max(1, int(rnd.lognormvariate(4, 1)))) for _ in range(rnd.choice([1, 7, 3000]))]
    groups = rnd.choice([1, 8, 512])
    runs = packing.plan(Counter(lengths), 256, groups)
    ranks, places = Counter(), {}
    for length, rank, n, per, first, offset in sorted(runs):
        assert rank == ranks[length]
        ranks[length] += n * per
        for k in range(n * per):
            places.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert ranks == Counter(lengths)
    for spots in places.values():
        at = 0
        for start, length in sorted(spots):
            assert start == at
            at += length
        assert at <= 256
    if groups == 512:  # one group rounds every large piece up to a whole sequence
        assert len(places) <= -(-sum(lengths) // 256) * 1.05 + 1


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(2)
    texts = [None, "", "Hello, world! Ünï don't 12 <|endoftext|>", "x<|startoftext|>Ab.<|ENDOFTEXT|> a\u00a0b\u2003c", "They'll say \"no\".) 3.14, é. É! ... ?! It's: İ. \u0130x ΣΑΣ. e\u0301, ſ \x1c a\x0bb", "a b " * 900, "x" * 3000, "İI ΣΑΣ é é"] + ["word " * n for n in range(1, 60)] * 3 + ["".join(rnd.choice("aBc.,:;!?'<|> \n19éΣ-\u0301") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    cut = packing.pieces(df, path, size=256).withColumns({c: F.lit("kept") for c in ("place", "within", "before", "offset")}).cache()
    got = packing.pack(cut, 256)
    assert got.columns == [*(c for c in cut.columns if c != "offset"), "sequence_id", "offset"]
    got = got.collect()
    assert {(r["place"], r["within"], r["before"]) for r in got} == {("kept",) * 3}
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        parts = sorted(by[i])
        assert b"".join(p[3] for p in parts) == ids and [p[1] for p in parts] == list(range(0, len(ids) // 4, 256))
    for spots in seq.values():
        at = 0
        for start, length in sorted(spots):
            assert start == at
            at += length
        assert at <= 256
    assert packing.pack(packing.pieces(df.filter("false"), path), 2048).count() == 0


def test_packing_query(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, by, seq = packing.op5(spark, sf).collect(), {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sorted(x) for i, x in by.items()} == {i: [(k // 2048, k, len(p := ids[k : k + 2048]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), 2048)] for i, ids in rows.items()}
    for spots in seq.values():
        assert [a for a, _ in sorted(spots)] == np.cumsum([0, *(n for _, n in sorted(spots))])[:-1].tolist() and sum(n for _, n in spots) <= 2048
    assert len(seq) <= -(-sum(map(len, rows.values())) // 2048) + 1
