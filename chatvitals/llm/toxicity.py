"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighed by context windows.

Learning (from labelled rows only, a bounded sample of them):

1. Words and word beginnings of the sampled texts, quoted uses apart, are counted by label; the strongest become candidates.
2. A greedy cover of the toxic rows picks a short lexicon of words and stems from the candidates.
3. The lexicon's trie is intersected with a Levenshtein automaton (one error from five letters, two from nine).  Each way
   to match (term, errors, plain or quoted) is a feature; a logistic regression over the sampled rows weighs them together, so a form near
   a common clean word weighs nothing or less, and a quoted use can speak for a clean text where labels say so.

Scoring maps over documents: the product automaton is determinised as words are read, most words die after two or
three letters.  A hit is quoted if it stands between quotation marks or beside a word of reporting (listed for the
corpus's four languages) within a window of words.  score = logistic(bias + sum of the weights of the ways that occur); a way that no
sampled row has counts as a share of its term's own weight, unless the term is hit in a known way as well.

Words of 3 to 40 letters are considered for the lexicon, and of those at most `candidates`, the strongest first; both bound what is
learned, not what is scored.  Null text counts as empty and scores as texts without hits do.  Empty tables give no rows.  Labels that are null are not learned from; a row labelled
twice is toxic if any label says so.  Without labelled rows the lexicon is empty.  Repeated rows score alike.
Columns of the input stay, `score` and `predicted` are added (columns of those names are replaced).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?()[]{}<>\"'“”‘’«»„"
OPEN, CLOSE = set("\"“„«‘"), set("\"”“»’")
#: Words of reporting in English, French, German and Spanish.
REPORT = {
    "said", "says", "wrote", "writes", "called", "quote", "quoted", "quoting", "word", "term", "slur", "reported",
    "dit", "disait", "écrit", "appelé", "citation", "cite", "mot", "terme", "insulte",
    "sagte", "sagt", "schrieb", "schreibt", "nannte", "zitat", "zitiert", "wort", "begriff",
    "dijo", "dice", "escribió", "escribe", "llamó", "cita", "citado", "palabra", "término", "insulto",
}
WINDOW = 4
NEAR = 128
PLAIN, QUOTED, AGAIN = range(3)
STEMS = (4, 5, 6, 7)
PENALTY = 0.25


class Automaton:
    """Lexicon trie and Levenshtein automaton as one machine, determinised on demand.

    A configuration is (trie node, errors so far); a stem's last node stays reached whatever follows."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        self.room = [0]
        for number, (text, stem) in enumerate(terms):
            allowed, node = 2 if len(text) >= 9 else 1 if len(text) >= 5 else 0, 0
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                self.room[node] = max(self.room[node], allowed)
                node = self.children[node][ch]
            self.room[node] = max(self.room[node], allowed)
            (self.stems if stem else self.ends)[node] = number
        self.allowed = [2 if len(t) >= 9 else 1 if len(t) >= 5 else 0 for t, _ in terms]
        self.letters = {ch for c in self.children for ch in c}
        self.states: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)}, frozenset())

    def _state(self, live: set[tuple[int, int]], reached: frozenset) -> int:
        stack, closed = list(live), set(live)
        while stack:  # letters of the term left out
            node, e = stack.pop()
            for child in self.children[node].values():
                if e < self.room[child] and (child, e + 1) not in closed:
                    closed.add((child, e + 1))
                    stack.append((child, e + 1))
        reached = set(reached)
        for node, e in closed:
            if (n := self.stems.get(node)) is not None and e <= self.allowed[n]:
                reached.add((n, e))
        key = tuple(sorted(closed)), tuple(sorted(reached))
        if key not in self.states:
            self.states[key] = len(self.configs)
            self.configs.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        configs, reached = self.configs[state]
        live = set()
        for node, e in configs:
            if (child := self.children[node].get(ch)) is not None:
                live.add((child, e))
            if e < self.room[node]:
                live.add((node, e + 1))
                live |= {(child, e + 1) for child in self.children[node].values() if e < self.room[child]}
        to = self._state(live, frozenset(reached)) if live or reached else -1
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> dict[int, int]:
        """Term to fewest errors with which the word (or, for a stem, its beginning) is the term."""
        state = self.start
        for ch in word:
            if ch not in self.letters:
                ch = ""
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return {}
        configs, reached = self.configs[state]
        found: dict[int, int] = {}
        for n, e in [*reached, *((self.ends[node], e) for node, e in configs if node in self.ends)]:
            if e <= self.allowed[n]:
                found[n] = min(e, found.get(n, 9))
        return found


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int, int], float]
    bias: float
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.terms, self.weights, self.bias

    def __setstate__(self, state):
        self.terms, self.weights, self.bias = state
        self.known = {}

    def hits(self, text: str) -> set[tuple[int, int, int]]:
        """(term, errors, mode) of a text's words; mode: PLAIN, QUOTED, or AGAIN if the plain hit follows another of its kind within NEAR words."""
        machine = self.known.get(None)
        if machine is None:
            machine = self.known[None] = Automaton(self.terms)
        tokens = TOKEN.findall(text.lower())
        known, hot = self.known, set()
        if len(known) > 200_000:
            known.clear()
            known[None] = machine
        for t in set(tokens):
            found = known.get(t)
            if found is None:
                found = known[t] = machine.match(t.strip(EDGE))
            if found:
                hot.add(t)
        if not hot:
            return set()
        out, last = set(), {}
        for i, t in enumerate(tokens):
            if t in hot:
                quoted = self._quoted(tokens, i)
                for way in known[t].items():
                    out.add((*way, QUOTED if quoted else PLAIN))
                    if not quoted:
                        if i - last.get(way, -NEAR - 1) <= NEAR:
                            out.add((*way, AGAIN))
                        last[way] = i
        return out

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        opened = any(t[0] in OPEN for t in [*before, tokens[i]]) and not any(len(t) > 1 and t.rstrip(".,;:!?")[-1:] in CLOSE for t in before)
        closed = any(t.rstrip(".,;:!?")[-1:] in CLOSE for t in [tokens[i], *after])
        return opened and closed or any(t.strip(EDGE) in REPORT for t in [*before, *after])

    def logit(self, hits: set[tuple[int, int, int]]) -> float:
        total, met = self.bias, {n for n, e, q in hits if (n, e, q) in self.weights}
        other: dict[int, float] = {}
        for n, e, q in hits:
            if (n, e, q) in self.weights:
                total += self.weights[n, e, q]
            elif n not in met:
                share = (0.8, 0.6, 0.3)[e] * (0.5 if q == QUOTED else 1)
                other[n] = max(other.get(n, 0.0), share * max(0.0, self.weights.get((n, 0, PLAIN), 0.0)))
        return total + sum(other.values())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(self.hits(text))))))


def _regression(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink), x.T @ (times * (y - p)) - shrink * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


_MARKED = re.compile("[" + re.escape("".join(sorted(OPEN | CLOSE))) + "]")


def _forms(text: str) -> set[str]:
    """Words (marked $) and beginnings of longer words; quoted uses are left out."""
    tokens = TOKEN.findall(text.lower())
    near = {k for i, t in enumerate(tokens) if _MARKED.search(t) or t.strip(EDGE) in REPORT for k in range(i - WINDOW, i + WINDOW + 1)}
    plain = {t for i, t in enumerate(tokens) if i not in near or not Model._quoted(tokens, i)} if near else set(tokens)
    words = {w for t in plain if 3 <= len(w := t.strip(EDGE)) <= 40}
    return {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, candidates: int = 2_000, least: int = 4, ridge: float = 0.05, sure: float = 0.9) -> Model:
    """Learns from `labels` (doc_id, toxic) and the texts of `docs` (doc_id, text).

    At most about `sample` labelled rows are used, picked by a hash of doc_id; that bounds what is broadcast and what the driver
    gathers (candidates, hits per sampled row)."""
    from .common import written

    labelled = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labelled.count()
    if total > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (sample << 30) // total)
    # bounded by `sample`: small enough to broadcast
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labelled), "doc_id").select("text", "toxic").distinct(), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sum(n for k, n in sizes.items() if k < 1), sum(n for k, n in sizes.items() if k >= 1)
    bias = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -4.0
    bias = max(-6.0, min(-0.5, bias))
    if not toxic:
        return Model([], {}, bias)

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = [Counter(), Counter()]
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    n[label >= 1].update(_forms(text))
                forms = list(n[0].keys() | n[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([n[0][f] for f in forms], pa.int64()), pa.array([n[1][f] for f in forms], pa.int64())], ["form", "n0", "n1"])

    counted = rows.mapInArrow(count, "form string, n0 long, n1 long").groupBy("form").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    strong = counted.filter((F.col("n1") >= least) & ((F.col("n1") + 0.5) / (toxic + 1) >= 8 * (F.col("n0") + 0.5) / (clean + 1)))
    found = [r["form"] for r in strong.orderBy(F.desc(F.col("n1") - PENALTY * F.col("n0")), F.desc(F.length("form")), "form").limit(candidates).select("form").collect()]
    index = {f: i for i, f in enumerate(found)}

    def incidence(batches):
        for batch in batches:
            out = [(label >= 1, sorted(index[f] for f in _forms(text) if f in index)) for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.bool_()), pa.array([b for _, b in out], pa.list_(pa.int32()))], ["toxic", "found"])

    cover = rows.mapInArrow(incidence, "toxic boolean, found array<int>").filter("size(found) > 0").collect()  # at most `sample` short rows
    chosen = _cover(found, [(r["toxic"], r["found"]) for r in cover], max(least, toxic // 1000))
    model = Model([(f.removesuffix("$"), not f.endswith("$")) for f in chosen], {}, bias)

    def ways(batches):
        for batch in batches:
            n: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n[label >= 1, tuple(sorted(model.hits(text)))] += 1
            found = [[{"term": t, "errors": e, "mode": q} for t, e, q in hits] for _, hits in n]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in n], pa.bool_()), pa.array(found, _WAYS), pa.array(list(n.values()), pa.int64())], ["toxic", "ways", "n"])

    seen = rows.mapInArrow(ways, "toxic boolean, ways array<struct<term:int,errors:int,mode:int>>, n long").groupBy("toxic", "ways").agg(F.sum("n").alias("n")).collect()  # at most `sample` short rows
    seen = sorted(((r["toxic"], [tuple(w) for w in r["ways"]], r["n"]) for r in seen), key=str)
    number = {way: i + 1 for i, way in enumerate(sorted({w for _, hits, _ in seen for w in hits}))}
    x = np.zeros((len(seen), len(number) + 1))
    x[:, 0] = 1
    for i, (_, hits, _) in enumerate(seen):
        x[i, [number[w] for w in hits]] = 1
    w = _regression(x, np.array([t for t, _, _ in seen], float), np.array([n for _, _, n in seen], float), ridge)
    n0, n1 = ((x * (np.array([t for t, _, _ in seen]) == label)[:, None] * np.array([n for _, _, n in seen])[:, None]).sum(0) for label in (False, True))
    alone = n1 / (n1 + n0 + 2)  # terms come together in texts, so each is weighed as one of several; what hardly ever stands in a clean one is enough by itself
    floor = np.where(alone >= sure, np.log(np.maximum(alone, 1e-9) / (1 - alone)) - w[0], -np.inf)
    model.bias, model.weights = float(w[0]), {way: float(max(w[i], floor[i])) for way, i in number.items()}
    return model


_WAYS = pa.list_(pa.struct([("term", pa.int32()), ("errors", pa.int32()), ("mode", pa.int32())]))


def _cover(forms: list[str], rows: list[tuple[bool, list[int]]], least: int) -> list[str]:
    """Greedy: the form with most toxic rows, where a row covered k times already counts 0.6**k, less PENALTY for each clean row it adds.

    If a longer form or whole word with the same beginning does nearly as well it is taken: it leaves more room for errors.  A form that begins
    another, or begins with it, is left out."""
    toxic = [found for label, found in rows if label]
    clean: dict[int, int] = Counter(f for label, found in rows if not label for f in found)
    holds = defaultdict(list)
    for k, found in enumerate(toxic):
        for f in found:
            holds[f].append(k)
    texts = [f.removesuffix("$") for f in forms]
    times, chosen = [0] * len(toxic), []
    while holds:
        value = [0.6**t for t in times]
        gains = {f: round(sum(value[k] for k in holds[f]) - PENALTY * clean[f], 6) for f in holds}
        best = max(holds, key=lambda f: (gains[f], forms[f]))
        if gains[best] < least:
            break
        best = max((f for f in holds if texts[f].startswith(texts[best]) and gains[f] >= 0.95 * gains[best]), key=lambda f: (forms[f].endswith("$"), len(forms[f]), forms[f]))
        chosen.append(forms[best])
        for k in holds[best]:
            times[k] += 1
        for f in list(holds):
            if texts[f].startswith(texts[best]) or texts[best].startswith(texts[f]):
                del holds[f]
    return chosen


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on)."""
    from .common import trim

    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                values = [model.score(t or "") for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], [*kept, "score", "predicted"])
        trim()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def train_labels(labels: DataFrame) -> DataFrame:
    """The rows to learn from: crc32(doc_id as text) mod 5 is not 0."""
    from .common import crc_mod

    return labels.select("doc_id", "toxic").filter(crc_mod("doc_id", 5) != 0)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import crc_mod, read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, train_labels(read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
