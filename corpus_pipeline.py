"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's
docs.  All but the last return the columns of documents, whatever their names: operators get the row as one struct.  Empty
tables give empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatvitals.llm import jaccard, packing, suffix_dedup, toxicity
from chatvitals.llm.common import free_names, read, written

#: Bytes of a repeated passage: fifty words of prose are longer in any of the languages.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; it learns from the labels that its query learns from.  Null and empty texts
    score the base rate and stay; repeated rows go or stay together."""
    labels = toxicity.train_labels(read(spark, sf_dir, "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rest = [c for c in docs.columns if c != "text"]
    scored = toxicity.score(docs.select("text", F.struct(*rest).alias("rest")), model)
    return scored.filter("predicted = 0").select(*(F.col("rest")[c].alias(c) if c in rest else c for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more on five words connect, the document with the smallest doc_id stays (null is the largest; of
    rows that share it the one with the smallest row key, of repeated rows one).  Documents without words all stay."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    (row,) = free_names(docs.columns, "row_key")
    kept = jaccard.groups(docs.select("doc_id", "text"), labels_too=True).filter("n_shingles > 0").groupBy("label").agg(first).select(F.col("first.row").alias(row))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    stay = docs.filter(~wordless).withColumn(row, jaccard.row_key("doc_id", "text")).join(kept, row, "left_semi").dropDuplicates([row, "doc_id", "text"])  # two documents may share a key
    return stay.select(*docs.columns).unionByName(docs.filter(wordless))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of PASSAGE_BYTES bytes or more that stand in several places the first, by doc_id (null last) and place, stays whole; the
    others are cut out of the texts, with the rest of a character that a cut goes through; n_chars follows.  Where the first copy of one overlaps a
copy of another, the longer has its way, so what two texts share by chance beside a passage does not keep it twice.  Texts without such passages, null ones
    among them, stay as they are; so do passages that only repeated rows share (the stage before leaves one row of those).  Very long texts are
    taken whole."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = suffix_dedup.repeats(docs.select("doc_id", "text", F.struct(*rest).alias("rest")), PASSAGE_BYTES, keep_first=True, longer_wins=True)
    whole = F.size("spans") == 0
    made = {"doc_id": F.col("doc_id"), "text": F.when(whole, F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(whole, F.col("rest")["n_chars"]).otherwise(F.length("kept_text").cast("long"))}
    return done.select(*(made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece.  Null texts count as empty; repeated rows are packed once each; other columns go."""
    return packing.op5_on(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", cut_repeats), ("packing", pack)]

#: No SQL: tokenizers, learned toxicity and best-fit packing are not SQL's; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
