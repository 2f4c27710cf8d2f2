"""New export files as a stream: each arriving file is scored once, as the batch analysis would score it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import held
from ..config import Vitals
from ..plans import analysis
from ..sources import exports


def watch(spark: SparkSession, directory: str, staff_path: str, now: Callable[[], datetime], sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: Vitals = Vitals(), once: bool = False) -> StreamingQuery:
    """Calls sink(metrics of the new groups, batch number) for every micro-batch of files in directory."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(directory)

    def batch(frame: DataFrame, number: int) -> None:
        files = frame.select(F.try_url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("source_file"), F.lit(0).alias("file_ord"), "content")
        with held.scope():
            raw, status = exports.parse(files, exports.load_staff(frame.sparkSession, staff_path), cfg)
            groups = status.filter("error is null").select("group_key", "group_id")
            sink(analysis.group_metrics(analysis.prepare(raw, cfg), analysis.clock(now()), groups, cfg), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
