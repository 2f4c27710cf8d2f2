"""Command line: a directory of exports to a ranked report."""

from __future__ import annotations

import argparse
import sys
import tempfile
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import held
from ..config import Vitals
from ..operators import issues, ledger
from ..sources import exports
from . import analysis, report


#: Bytes of a file from which on files are read in splits.
LARGE = 64 << 20


def run(spark: SparkSession, conversations: str, staff: str, now: datetime, make_extractor=None, cfg: Vitals = Vitals(), book: str | None = None, model: str = "", per_minute: float | None = None):
    """(ranked, messages, file status, issues or None); with a folder `book` calls of the extractor are kept there and never repeated."""
    at = analysis.clock(now)
    listed, rows = exports.scan_lines(spark, conversations)
    known = exports.load_staff(spark, staff)
    if (listed.agg(F.max("bytes")).first()[0] or 0) > LARGE:
        raw, status = exports.parse_splits(listed, rows, known, cfg)
    else:
        raw, status = exports.parse(exports.scan_conversations(spark, conversations, files=listed), known, cfg, keep=True)
    messages = analysis.once(analysis.prepare(raw, cfg))
    groups = status.filter("error is null").select("group_key", "group_id", "file_ord")
    metrics = analysis.group_metrics(messages, at, groups, cfg)
    found = None
    if make_extractor is not None:
        metrics = analysis.once(metrics)
        texts = issues.transcripts(messages).join(issues.gate(metrics, cfg).select("group_key"), "group_key", "left_semi")
        # calls may cost: never repeated
        replies = analysis.once(ledger.extract(texts, make_extractor, book, model, per_minute)) if book else issues.extract(texts, make_extractor).checkpoint()
        found, answered = issues.parse_replies(replies)
        status = status.join(answered.select("group_key", F.col("error").alias("reply_error")), "group_key", "left")
        metrics = analysis.with_issues(metrics, found, at, cfg)
    return analysis.ranked(metrics, "file_ord"), messages, status, found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chatvitals")
    p.add_argument("--conversations", default="data/conversations")
    p.add_argument("--employees", default="data/employees.txt")
    p.add_argument("--now", type=datetime.fromisoformat, default=None)
    p.add_argument("--llm", help="module:function that makes an extractor (text to JSON)")
    p.add_argument("--llm-threshold", type=float, default=0.3)
    p.add_argument("--llm-ledger", help="a folder that the driver and all executors share: replies are kept there, and no call is made twice")
    p.add_argument("--llm-per-minute", type=float, help="with --llm-ledger: the most calls a minute")
    p.add_argument("--report", action="store_true")
    p.add_argument("--report-dir", default="reports")
    p.add_argument("--pages", action="store_true", help="with --report: a folder with an index and a page for each group, written by the tasks")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    make = None
    if a.llm:
        import importlib

        module, _, name = a.llm.partition(":")
        make = getattr(importlib.import_module(module), name)
        if not a.llm_ledger and not spark.sparkContext.getCheckpointDir():  # replies are kept there
            if not spark.sparkContext.master.startswith("local["):
                p.error("--llm needs spark.checkpoint.dir, a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chatvitals-"))
    with held.scope():
        try:
            ranked, messages, status, found = run(spark, a.conversations, a.employees, a.now or datetime.now().replace(microsecond=0), make, Vitals(gate=a.llm_threshold), a.llm_ledger, a.llm or "", a.llm_per_minute)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
        ranked = analysis.once(ranked)
        for r in report.file_status(status, ranked).orderBy("source_file").toLocalIterator():
            print(f"[{r['status']}] {r['source_file']}" + (f": {r['error']}" if r["error"] else f" composite={r['composite']:.3f} tripwire={r['n_tripwire']}"))
        if found is not None:
            for r in status.filter("reply_error is not null").orderBy("group_key").toLocalIterator():
                print(f"[ISSUES] {r['group_key']}: {r['reply_error']}", file=sys.stderr)
        print(report.text_report(ranked, found=found))
        if a.report and a.pages:
            print(report.write_pages(messages, ranked, report.report_name(a.report_dir, datetime.now(), ""), found))
        elif a.report:
            print(report.write_html(report.report_blocks(messages, ranked, found), report.report_texts(ranked, found), report.report_name(a.report_dir, datetime.now())))
        return 0


if __name__ == "__main__":
    sys.exit(main())
