"""Exported chats: text files, one group each, and the staff list.

Files are listed on the driver, so that empty files keep their (default) row; contents come from Spark's binary reader.
A file that is not UTF-8, or whose date headers or message times are impossible, fails as a whole and is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions.text import SPACE, lines, rstrip, strip
from ..held import once
from ..operators import lanes

DATE = r"^(\d{4})\.(\d{2})\.(\d{2})" + SPACE + "+星期"
MESSAGE = r"^(\d{2}):(\d{2})\t(.+?)\t(.+)$"
TAG = "[LINE]"


def scan_conversations(spark: SparkSession, directory: str, pattern: str = "*.txt", files: DataFrame | None = None) -> DataFrame:
    """(source_file, file_ord, content) of the directory's files, sorted by name; raises FileNotFoundError if there are none.

    files: the listing that scan_lines gave, so that the directory is not listed again."""
    files = _listed(spark, directory, pattern) if files is None else files
    files = files.select("source_file", "file_ord")
    contents = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.join(contents.select(_file_name(F.col("path")).alias("source_file"), "content"), "source_file", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def _file_name(path: Column) -> Column:
    return F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _listed(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(source_file, file_ord, bytes) of the directory's files, sorted by name.

    Names come from the driver's file system in one piece, sizes from Spark's listing; only what that leaves out (empty and hidden files,
    directories) is asked for one by one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern))
    names = []
    if found is not None and len(found):
        parent = found[0].getPath().getParent()
        top = f"{parent.toString().rstrip('/')}/"
        said = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
        names = sorted(said[1:-1].removeprefix(top).split(f",{top}"))  # no name has a slash
    if not names:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select(_file_name(F.col("path")).alias("source_file"), F.col("length").alias("bytes"))
    sizes = once(sizes)
    every = spark.createDataFrame([(n,) for n in names], "source_file string")
    others = {r[0]: fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(parent, jvm.org.apache.hadoop.fs.Path(None, None, f"./{r[0]}"))) for r in every.join(sizes, "source_file", "left_anti").toLocalIterator()}
    names = [n for n in names if n not in others or others[n].isFile()]
    if not names:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    listed = spark.createDataFrame([(n, i, others[n].getLen() if n in others else None) for i, n in enumerate(names)], "source_file string, file_ord int, _bytes long")
    return listed.join(sizes, "source_file", "left").select("source_file", "file_ord", F.coalesce("_bytes", "bytes").alias("bytes"))


def load_staff(spark: SparkSession, path: str) -> DataFrame:
    """Distinct senders; blank lines and lines that begin with # are dropped."""
    line = F.explode(lines(F.col("value"))).alias("line")
    return spark.read.text(path, wholetext=True).select(line).filter((strip(F.col("line")) != "") & ~F.col("line").startswith("#")).select(strip(F.col("line")).alias("sender")).distinct()


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def line_fields(rows: DataFrame) -> DataFrame:
    """Adds what a line (raw) alone tells: is_date and day (null: impossible), is_message, minute of the day (null: impossible), sender, body."""
    rows = rows.withColumn("line", rstrip(F.col("raw")))
    part = lambda p, i: F.regexp_extract("line", p, i)
    day = F.try_make_timestamp_ntz(*(part(DATE, i).try_cast("int") for i in (1, 2, 3)), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    rows = rows.withColumn("is_date", F.coalesce(F.col("line").rlike(DATE), F.lit(False))).withColumn("day", F.when(F.col("is_date") & (part(DATE, 1) != "0000"), day))
    rows = rows.withColumn("is_message", F.coalesce(~F.col("is_date") & F.col("line").rlike(MESSAGE), F.lit(False)))
    hour, minute = part(MESSAGE, 1).try_cast("int"), part(MESSAGE, 2).try_cast("int")
    return rows.withColumns({"minute": F.when((hour < 24) & (minute < 60), hour * 60 + minute), "sender": strip(part(MESSAGE, 3)), "body": strip(part(MESSAGE, 4))})


def scan_lines(spark: SparkSession, directory: str, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """(files, lines) for exports of any size: files as scan_conversations lists them, without contents; lines (source_file, LANE, valid, at, raw) from Spark's
    text reader, which cuts files into splits at line ends.  A split is a lane; `at` is a line's place in it.

    Unlike contents, lines lose a byte order mark at the start of a file."""
    text = spark.read.option("pathGlobFilter", pattern).text(directory)
    row = text.select("value", _file_name(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lane = F.shiftright("block", 6).cast("int")  # splits are longer than 64 bytes
    parts = F.when(F.col("value") == "", F.array(F.lit(""))).otherwise(lines(F.col("value")))
    rows = row.select("source_file", lane.alias(lanes.LANE), F.is_valid_utf8("value").alias("valid"), "row", F.posexplode(parts).alias("part", "raw"))
    return _listed(spark, directory, pattern), rows.select("source_file", lanes.LANE, "valid", F.struct("row", "part").alias("at"), "raw")


def parsed_splits(files: DataFrame, rows: DataFrame) -> DataFrame:
    """parsed_lines for what scan_lines gives: numbers and dates are carried over splits."""
    rows = lanes.running(rows, {"line_no": lanes.Scan("sum", F.lit(1).cast("long"))}, "source_file", "at")
    rows = once(rows.drop("at"))
    head = rows.filter((F.col("line_no") == 0) & F.col("raw").startswith(TAG)).select("source_file", strip(F.replace("raw", F.lit(TAG), F.lit(""))).alias("_name"))
    named = files.join(head, "source_file", "left").select("source_file", "file_ord", F.coalesce("_name", _stem(F.col("source_file"))).alias("group_id"))
    rows = line_fields(rows)
    return _dated(named.join(rows, "source_file", "left").withColumns({"valid": F.coalesce("valid", F.lit(True)), lanes.LANE: F.coalesce(lanes.LANE, F.lit(0)), "line_no": F.coalesce("line_no", F.lit(0)), "is_date": F.coalesce("is_date", F.lit(False)), "is_message": F.coalesce("is_message", F.lit(False))}))


def parsed_lines(files: DataFrame, lane_rows: int | None = None) -> DataFrame:
    """One row per line with its date, time and fields, and whether it spoils its file; with lane_rows in lanes of as many lines."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    base = files.select("source_file", "file_ord", valid.alias("valid"), F.when(valid, lines(text)).otherwise(F.array().cast("array<string>")).alias("lines"))
    name = F.when(F.element_at(F.when(F.size("lines") > 0, F.col("lines")), 1).startswith(TAG), strip(F.replace(F.element_at(F.when(F.size("lines") > 0, F.col("lines")), 1), F.lit(TAG), F.lit("")))).otherwise(_stem(F.col("source_file")))
    rows = line_fields(base.select("source_file", "file_ord", "valid", F.coalesce(name, _stem(F.col("source_file"))).alias("group_id"), F.posexplode_outer("lines").alias("line_no", "raw")))
    if lane_rows:
        rows = rows.withColumn(lanes.LANE, F.floor(F.col("line_no") / lane_rows).cast("int")).repartition("source_file", lanes.LANE)
    return _dated(rows)


def _dated(rows: DataFrame) -> DataFrame:
    """Adds current (the date that holds), ts and spoiled."""
    rows = lanes.running(rows, {"_day": lanes.Scan("last", F.col("day"))}, "source_file", "line_no")
    rows = rows.withColumn("current", F.coalesce("day", "_day"))
    at = F.when(F.col("minute").isNotNull(), F.timestamp_add("MINUTE", F.col("minute"), F.col("current")))
    rows = rows.withColumn("ts", F.when(F.col("is_message"), at))
    spoiled = (F.col("is_date") & F.col("day").isNull()) | (F.col("is_message") & F.col("current").isNotNull() & F.col("ts").isNull())
    return rows.withColumn("spoiled", ~F.col("valid") | F.coalesce(spoiled, F.lit(False)))


def parse(files: DataFrame, staff: DataFrame, cfg: Vitals = Vitals(), long_files: bool = False, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, status): messages of sound files, and for every file its group and error (null: none).  Rows are keyed by group_key, the file.

    long_files: files of more than cfg.lane_rows lines come in lanes of as many lines, so dates and numbers are carried over lanes.
    keep: files are read and parsed once, however often messages and status are used."""
    rows = parsed_lines(files, cfg.lane_rows if long_files else None)
    return _messages(once(rows) if keep else rows, staff, cfg)


def parse_splits(files: DataFrame, rows: DataFrame, staff: DataFrame, cfg: Vitals = Vitals()) -> tuple[DataFrame, DataFrame]:
    """parse for what scan_lines gives: a file of any size is parsed by as many tasks as it has splits."""
    return _messages(parsed_splits(files, rows), staff, cfg)


def _messages(rows: DataFrame, staff: DataFrame, cfg: Vitals) -> tuple[DataFrame, DataFrame]:
    long_files = lanes.LANE in rows.columns
    status = rows.groupBy("source_file").agg(F.min("file_ord").alias("file_ord"), F.min("group_id").alias("group_id"), F.when(~F.bool_and("valid"), "not UTF-8").when(F.bool_or("spoiled"), "impossible date or time").alias("error"))
    status = status.withColumnRenamed("source_file", "group_key")
    if long_files:
        bad = rows.filter("spoiled").select("source_file").distinct()
        good = rows.join(bad, "source_file", "left_anti")
    else:
        good = rows.withColumn("_bad", F.max(F.col("spoiled").cast("int")).over(Window.partitionBy("source_file"))).filter("_bad = 0")
    good = good.filter("is_message and current is not null").filter(~F.col("sender").isin(*cfg.system_senders))
    # the staff list is joined, not collected: Spark broadcasts it if it measures small
    good = good.join(staff.select(F.col("sender").alias("_staff")), F.col("sender") == F.col("_staff"), "left")
    good = lanes.running(good, {"_before": lanes.Scan("sum", F.lit(1).cast("long"))}, "source_file", "line_no")
    sticker, image = F.col("body").isin(*cfg.sticker), F.col("body").isin(*cfg.image)
    messages = good.select(
        F.col("source_file").alias("group_key"),
        "group_id",
        F.col("line_no").cast("long").alias("seq"),
        F.format_string("%s_%05d", F.col("group_id"), F.col("_before") + 1).alias("msg_id"),
        "sender",
        F.when(F.col("_staff").isNotNull(), "staff").otherwise("customer").alias("role"),
        "ts",
        F.when(sticker | image, "").otherwise(F.col("body")).alias("text"),
        sticker.alias("is_sticker"),
        image.alias("is_image"),
        *([lanes.LANE] if long_files else []),
    )
    return messages, status
