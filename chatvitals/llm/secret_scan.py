"""Secrets in texts, by a trigram inverted index; DataFrame functions only.

1. From each rule's regular expression a Boolean query is derived (`trigram_query`): an OR of branches, each an AND of trigrams that every
   match of the branch holds.  A rule with a branch without trigrams has none that are mandatory, and scans fully.
2. The index has postings (trigram, text) for the trigrams that the rules ask for, sorted by trigram; texts go by a 128-bit digest, so copies
   are one posting.  The pass that makes it also runs the rules that scan fully, as every text is at hand there.
3. Postings of a branch are intersected by counting: a text is a candidate where it has all trigrams of a branch.  Candidates are verified by the
   expression itself, on one row of each text; rows that are surely none are left out by a table of hash buckets of fixed size before texts are
   shuffled.
4. Matches leave as lengths of gaps and matches, and a running sum over one text's matches makes spans of them.

Matches are leftmost and do not overlap, per rule; those whose tested group is too short are dropped afterwards, so what they cover
is used up.  Spans are code points, end exclusive.

Nulls: null text counts as empty, null ids are ids like others.  Ties and repeated rows: each row has its own result, found once per different
text.  Very long texts are scanned whole, in time linear in their length; all spans of one text meet in one task.  Empty tables give no rows.
Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import near_rows, written


class Rule(NamedTuple):
    """least: characters that the group has to have; fold: letters in either case."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False


#: The three kinds that results are compared by.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds: key blocks and tokens with a prefix of their own.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

#: Largest class that is written out, and most alternatives that are kept apart.
CLASS, BRANCHES = 5, 256


def _literals(items) -> set[tuple[str, ...]]:
    """What a parsed expression matches, as alternatives of literal stretches; anything may stand between two stretches."""
    found = {("",)}
    for item in items:
        found = {(*a[:-1], a[-1] + b[0], *b[1:]) for a in found for b in _one(item)}
        # a stretch inside that is too short for a trigram says nothing
        found = {(a[0], *(s for s in a[1:-1] if len(s) > 2), a[-1]) if len(a) > 1 else a for a in found}
        if len(found) > BRANCHES:
            found = {("", "")}
    return found


def _one(item) -> set[tuple[str, ...]]:
    kind, value = item
    anything = {("", "")}
    if kind is sre.LITERAL:
        return {(chr(value),)}
    if kind is sre.IN:
        chars: set[str] = set()
        for how, x in value:
            if how is sre.LITERAL:
                chars.add(chr(x))
            elif how is sre.RANGE and x[1] - x[0] < CLASS:
                chars |= set(map(chr, range(x[0], x[1] + 1)))
            else:
                return anything
        return {(c,) for c in chars} if len(chars) <= CLASS else anything
    if kind is sre.SUBPATTERN:
        return _literals(value[-1])
    if kind is sre.BRANCH:
        return set().union(*map(_literals, value[1]))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        if least == 0:
            return {("",)} | _literals(inner) if most == 1 else anything
        return _literals([*list(inner) * min(least, 3), *([] if most == least <= 3 else [(sre.ANY, None)])])
    return {("",)} if kind is sre.AT else anything


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of trigrams, in lower case: a match has all trigrams of one of them.  Empty: no trigram is mandatory."""
    branches = {frozenset(s[i : i + 3].lower() for s in a for i in range(len(s) - 2)) for a in _literals(_parser.parse(pattern))}
    return [] if frozenset() in branches else sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


def _expression(rule: Rule) -> str:
    return "(?i)" * rule.fold + rule.pattern


def cuts(text: Column, rule: Rule) -> Column:
    """Array of a rule's matches in a text: characters before each since the last one, its own, and those of the tested group."""
    e = F.lit(_expression(rule))
    gaps = F.transform(F.split(text, _expression(rule), -1), F.length)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, e, F.lit(group)), F.length)
    whole = F.zip_with(lengths(0), gaps, lambda n, gap: F.struct(gap.alias("gap"), n.alias("n")))
    both = F.zip_with(whole, lengths(rule.group), lambda x, tested: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), tested.alias("tested")))
    return F.when(text.rlike(_expression(rule)), F.filter(both, lambda x: x["n"].isNotNull()))


def _full(rule: Rule) -> Rule:
    """A rule whose matches are whole runs of one class finds the same with the length in the expression, without its many short matches."""
    body = list(_parser.parse(rule.pattern))
    run = len(body) == 1 and body[0][0] is sre.MAX_REPEAT and body[0][1][:2] == (1, sre.MAXREPEAT) and len(body[0][1][2]) == 1 and body[0][1][2][0][0] is sre.IN
    return rule._replace(pattern=f"{rule.pattern[:-1]}{{{rule.least},}}") if run and rule.group == 0 else rule


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _array(values, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


class Index(NamedTuple):
    rows: DataFrame  # (who, doc_id, key, found): every row; found: cuts of the rules that scan fully
    postings: DataFrame  # (trigram, key)


def index(docs: DataFrame, rules: tuple[Rule, ...]) -> Index:
    """From (doc_id, text).  Written tables."""
    wanted = sorted({t for r in rules for b in trigram_query(r.pattern) for t in b})
    full = [_full(r) for r in rules if not trigram_query(r.pattern)]
    text = F.col("text")
    held = F.transform(F.array(F.lower(text)), lambda s: F.filter(_array(wanted, "string"), lambda t: F.contains(s, t)))[0]
    scanned = [F.struct(F.lit(r.name).alias("rule"), cuts(text, r).alias("cuts")) for r in full]
    found = F.filter(F.array(*scanned), lambda x: x["cuts"].isNotNull()) if scanned else F.array().cast("array<struct<rule:string,cuts:array<struct<gap:int,n:int,tested:int>>>>")
    rows = written(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("who"), "doc_id", text_key(text).alias("key"), held.alias("trigrams"), found.alias("found")), "secret-rows")
    postings = rows.select(F.explode("trigrams").alias("trigram"), "key").distinct()
    return Index(rows.drop("trigrams"), written(postings.repartitionByRange("trigram", "key").sortWithinPartitions("trigram", "key"), "secret-postings"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): texts that have all trigrams of a branch of those rules."""
    branches = [(r.name, b) for r in rules for b in trigram_query(r.pattern)]
    if not branches:
        return postings.select("key", F.array().cast("array<string>").alias("rules")).limit(0)
    wanted = sorted({t for _, b in branches for t in b})
    of = F.create_map(*(x for t in wanted for x in (F.lit(t), _array([i for i, (_, b) in enumerate(branches) if t in b], "int"))))
    asked = postings.filter(F.col("trigram").isin(wanted)).select("key", F.explode(F.element_at(of, F.col("trigram"))).alias("branch"))
    at = F.col("branch") + 1
    met = asked.groupBy("key", "branch").agg(F.count("*").alias("n")).filter(F.col("n") == F.element_at(_array([len(b) for _, b in branches], "int"), at))
    return met.groupBy("key").agg(F.collect_set(F.element_at(_array([r for r, _ in branches], "string"), at)).alias("rules"))


def verified(docs: DataFrame, rows: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule, cuts) of candidates (key, rules) that match, each from one row that has the text."""
    one = rows.groupBy("key").agg(F.min("who").alias("who")).join(chosen, "key")
    one = written(one.withColumn("row", F.xxhash64("who", "key")), "secret-candidates")
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(who.alias("who"), text_key(F.col("text")).alias("key"), "text").withColumn("row", F.xxhash64("who", "key"))
    met = near_rows(texts, one, "row").select("who", "key", "text").join(one.drop("row"), ["who", "key"])
    tried = [F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("rules", r.name), cuts(F.col("text"), r)).alias("cuts")) for r in rules if trigram_query(r.pattern)]
    return met.select("key", F.inline(F.filter(F.array(*tried), lambda x: x["cuts"].isNotNull())))


def spans(df: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (start, ord, kind, end) in order, ord being the rule's place in rules."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = index(docs, rules)
    matches = made.rows.select("key", F.inline("found"))
    if any(trigram_query(r.pattern) for r in rules):
        matches = matches.unionByName(verified(docs, made.rows, candidates(made.postings, rules), rules))
    each = matches.dropDuplicates(["key", "rule"]).select("key", "rule", F.posexplode("cuts").alias("i", "c"))
    to_end = Window.partitionBy("key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = each.select("key", "rule", "c", F.sum(F.col("c.gap") + F.col("c.n")).over(to_end).alias("end"))
    place = {r.name: i for i, r in enumerate(rules)}
    of = lambda values: F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(values(r))))), F.col("rule"))
    kept = ended.filter(F.col("c.tested") >= of(lambda r: r.least))
    span = F.struct((F.col("end") - F.col("c.n")).alias("start"), of(lambda r: place[r.name]).alias("ord"), F.col("rule").alias("kind"), F.col("end").alias("end"))
    found = kept.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(found.schema["spans"].dataType)
    return made.rows.select("doc_id", "key").join(found, "key", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def shown(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", *(count(r.name) for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
