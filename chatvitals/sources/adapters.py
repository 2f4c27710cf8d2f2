"""Driver tables seen as chats, so that every operator meets data of its kind.  The SQL twins are in chatvitals.queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Vitals
from . import named_files

GAPS = (0, 1, 1, 7, 45, 200, 700, 6000)
PHRASES = (
    "請問這週可以完工嗎？",
    "麻煩傳一下報價",
    "我要退款，太誇張",
    "好的",
    "謝謝！",
    "覺得品質不太好",
    "早安！",
    "貼圖",
    "圖片",
    "這樣可以",
    "不合理",
    "颱風來了",
    "需要週三可以看到樣品",
    "好，麻煩你們了！",
    "沒問題 👍",
)
CHAT_NOW = "2025-09-05 17:00:00"
EVENT_NOW = "2024-01-31 00:00:00"


def _pick(index, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)


def chat_messages(spark: SparkSession, sf_dir: str, cfg: Vitals = Vitals()) -> DataFrame:
    """conversations as messages: a fragment per line, roles and times made from the keys, the first fragment of most turns a phrase."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("gap", F.sum(_pick(((F.col("conv_id") * 31 + F.col("turn") * 17) % 8).cast("int"), GAPS)).over(w))
    rows = turns.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "gap", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    which = ((F.col("conv_id") * 7 + F.col("turn") * 3) % 16).cast("int")
    body = F.trim(F.when((F.col("line_no") == 0) & (which < 15), F.try_element_at(F.array(*(F.lit(p) for p in PHRASES)), which + 1)).otherwise(F.col("line")))
    rows = rows.withColumn("body", body).filter("body <> ''")
    sticker, image = F.col("body").isin(*cfg.sticker), F.col("body").isin(*cfg.image)
    staff = F.col("role") == "assistant"
    seq = (F.col("turn") * 1000 + F.col("line_no")).cast("long")
    minutes = ((F.col("conv_id") % 5) * 1440 + F.col("gap") + F.col("line_no")).cast("int")
    counter = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    rows = rows.withColumn("seq", seq)
    return rows.select(
        F.col("conv_id").alias("group_key"),
        F.col("conv_id").cast("string").alias("group_id"),
        "seq",
        F.format_string("%s_%05d", F.col("conv_id").cast("string"), counter).alias("msg_id"),
        F.concat(F.when(staff, "staff").otherwise("customer"), (F.col("conv_id") % 3).cast("string")).alias("sender"),
        F.when(staff, "staff").otherwise("customer").alias("role"),
        F.timestamp_add("MINUTE", minutes, F.expr("timestamp_ntz'2025-09-01 08:00:00'")).alias("ts"),
        F.when(sticker | image, "").otherwise(F.col("body")).alias("text"),
        sticker.alias("is_sticker"),
        image.alias("is_image"),
    )


def crowd_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, those of nine conversations in ten as one giant group, one conversation after the other."""
    g = F.col("group_key")
    crowd = F.when(g % 10 < 9, 0).otherwise(g)
    return chat_messages(spark, sf_dir).withColumns({"seq": g * 10_000_000 + F.col("seq"), "group_key": crowd, "group_id": crowd.cast("string")})


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as enriched messages: errors ask, purchases answer, the rest is talk."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    staff = F.col("event_type") == "purchase"
    return e.select(
        F.col("user_id").alias("group_key"),
        seq.alias("seq"),
        F.when(staff, "staff").otherwise("customer").alias("role"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.coalesce("props", F.lit("")).alias("text"),
        F.when(F.col("event_type") == "error", "question").otherwise("answer").alias("dialogue_act"),
        F.lit(False).alias("is_sticker"),
    )


def export_rows(messages: DataFrame) -> DataFrame:
    """(group_key, seq, line): messages as lines of export text, each date before its first message, with lines a parser must drop."""
    w = Window.partitionBy("group_key").orderBy("seq")
    day = F.date_format("ts", "yyyy.MM.dd")
    body = F.when(F.col("is_sticker"), "貼圖").when(F.col("is_image"), "圖片").otherwise(F.col("text"))
    line = F.concat(F.date_format("ts", "HH:mm"), F.lit("\t"), F.col("sender"), F.lit("\t"), body)
    head = F.when(F.coalesce(F.lag(day).over(w) != day, F.lit(True)), F.concat(day, F.lit(" 星期一\n09:00\t系統訊息\tjoined\nnot a message\n"))).otherwise("")
    return messages.select("group_key", "seq", F.concat(head, line).alias("line"))


def export_head() -> Column:
    """What an export begins with."""
    return F.concat(F.lit("[LINE] group "), F.col("group_key").cast("string"), F.lit("\nsaved today\n08:00\tnobody\tbefore any date\n"))


def export_files(messages: DataFrame) -> DataFrame:
    """(source_file, file_ord, content): a file per group."""
    rows = export_rows(messages)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n")
    content = F.concat(export_head(), F.col("text"), F.lit("\n"))
    return rows.groupBy("group_key").agg(text.alias("text")).select(F.concat(F.col("group_key").cast("string"), F.lit(".txt")).alias("source_file"), F.col("group_key").cast("int").alias("file_ord"), content.cast("binary").alias("content"))


def write_exports(messages: DataFrame, folder: str) -> tuple[str, str]:
    """Writes the groups' exports and the staff list into the folder, a line a row, so that no export is held whole; returns their places.

    Every tenth group has two more files, of which one has an impossible date and one is not UTF-8."""
    named = lambda prefix: F.concat(F.lit(prefix), F.col("group_key").cast("string"), F.lit(".txt")).alias("file")
    rows = export_rows(messages).select(named(""), F.lit(1).alias("part"), "seq", F.concat("line", F.lit("\n")).cast("binary").alias("data"))
    keys = messages.select("group_key").distinct()
    heads = keys.select(named(""), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), export_head().cast("binary").alias("data"))
    tenth = keys.filter("group_key % 10 = 9")
    spoiled = [tenth.select(named(prefix), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(data).alias("data")) for prefix, data in (("x", "2025.13.05 星期五\n09:00\tAmy\thi\n".encode()), ("y", b"\xff\xfe"))]
    # staff is listed once a group, so most names repeat
    staff = messages.filter("role = 'staff'").select("group_key", "sender").distinct()
    staff = staff.select(F.lit("staff.list").alias("file"), F.lit(1).alias("part"), F.col("group_key").cast("long").alias("seq"), F.concat(F.lit("  "), "sender", F.lit(" \n\n# once a group\n")).cast("binary").alias("data"))
    first = messages.sparkSession.range(1).select(F.lit("staff.list").alias("file"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(b"# staff\n").alias("data"))
    every = heads
    for part in (rows, *spoiled, first, staff):
        every = every.unionByName(part)
    where = named_files.write(named_files.clustered(every, "part", "seq"), folder)
    return where, f"{where}/staff.list"


def canned_replies(messages: DataFrame) -> DataFrame:
    """(group_key, reply): extractor replies made from the groups' keys: clean, wrapped in prose, without JSON, broken, a bare list."""
    k = F.col("group_key")
    issue = lambda n, status, at, more="": F.format_string(f'{{"issue_id": "%d-{n}", "type": "request", "status": "{status}", "summary": "s %d", "raised_at": "%s"{more}}}', k, k, at)
    at1 = F.concat(F.lit("2025-09-0"), (k % 5 + 1).cast("string"), F.lit("T10:00:00"))
    at2 = F.concat(F.lit("2025-09-0"), (k % 4 + 1).cast("string"), F.lit("T08:30:00Z"))
    body = F.concat(F.lit('{"issues": ['), issue(1, "unresolved", at1), F.lit(", "), issue(2, "resolved", at2, ', "owner": {"team": "blue", "floors": [1, 2.5]}, "cost": 17'), F.lit(", "), issue(3, "unclear", at2), F.lit("]}"))
    reply = F.when(k % 7 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).when(k % 7 == 2, "nothing found").when(k % 7 == 3, "{broken}").when(k % 7 == 4, F.concat(F.lit("["), issue(1, "unclear", at1), F.lit("]"))).when(k % 7 == 5, '{"issues": []}').otherwise(body)
    return messages.select("group_key").distinct().select("group_key", reply.alias("reply"))


LINE = re.compile(r"\[(\S+)\] \[customer\] \[\S+\] [^:]*: (.*？.*)")


def asking_lines():
    """An extractor without a model: every customer line with a question mark is an open issue."""

    def call(transcript: str) -> str:
        found = [LINE.fullmatch(x) for x in transcript.split("\n")]
        return json.dumps({"issues": [{"type": "question", "status": "unresolved", "raised_at": m[1], "summary": m[2]} for m in found if m]}, ensure_ascii=False)

    return call
