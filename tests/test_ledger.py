import json
import os
import subprocess
import sys
import threading
import time

import pandas as pd

from chatvitals.operators import ledger


def _noting(folder, wait=0.0, fail=""):
    """An extractor that notes every call as a file."""

    def make():
        def call(text):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").write(text)
            time.sleep(wait)
            if fail and fail in text:
                raise RuntimeError("no answer")
            return json.dumps({"issues": [], "echo": text})

        return call

    return make


def _calls(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def _texts(spark):
    return spark.createDataFrame(pd.DataFrame({"group_key": ["a", "b", "c", "d", "e"], "transcript": ["one", "two", "one", "bad é", None]}))


def _got(df):
    return {r.group_key: (json.loads(r.reply)["echo"] if r.reply else None, r.failure) for r in df.collect()}


def test_one_call_per_transcript(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    want = {"a": ("one", None), "b": ("two", None), "c": ("one", None), "d": (None, "RuntimeError: no answer"), "e": (None, None)}
    for _ in range(2):
        assert _got(ledger.extract(_texts(spark).repartition(4), _noting(tmp_path / "calls", 0.2, "bad"), str(tmp_path / "book"), "m1")) == want
    # errors are asked again, nothing else is
    assert _calls(tmp_path / "calls") == ["bad é", "bad é", "one", "two"]
    assert _got(ledger.extract(_texts(spark), _noting(tmp_path / "calls"), str(tmp_path / "book"), "m1"))["d"] == ("bad é", None)
    # another model asks anew
    ledger.extract(_texts(spark).filter("group_key = 'b'"), _noting(tmp_path / "calls"), str(tmp_path / "book"), "m2").collect()
    assert _calls(tmp_path / "calls") == ["bad é"] * 3 + ["one", "two", "two"]
    kept = sorted((r.model, json.loads(r.reply)["echo"]) for r in ledger.entries(spark, str(tmp_path / "book")).collect())
    assert kept == [("m1", "bad é"), ("m1", "one"), ("m1", "two"), ("m2", "two")]


def test_attempts_side_by_side(tmp_path):
    made, got = [], []

    def attempt(me):
        book = ledger.Ledger(f"file://{tmp_path}", "m")
        got.append(book.once("abcd", me, lambda: made.append(me) or time.sleep(0.3) or "reply"))

    threads = [threading.Thread(target=attempt, args=(f"t{i}",)) for i in (3, 1, 4, 2, 5, 0)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(20)
    assert got == ["reply"] * 6 and len(made) == 1


def test_a_lot_of_calls_settles_once(tmp_path):
    slept, names = [], [f"{i:04d}" for i in range(300)]
    book = ledger.Ledger(f"file://{tmp_path}", "m", sleep=slept.append)
    got = {d: reply for d, reply, error in book.each(names, "me", lambda d: d + "!")}
    assert got == {d: d + "!" for d in names} and slept == [0.05] * 2  # 300 with a call each
    # replies that are there are not claimed, and one call's failure leaves the others alone
    got = {d: (reply, str(error)) for d, reply, error in book.each([*names, "b1", "b2"], "you", lambda d: 1 / 0 if d == "b1" else "new")}
    assert got["0007"] == ("0007!", "None") and got["b1"] == (None, "division by zero") and got["b2"] == ("new", "None") and len(slept) == 3


def test_slow_calls_are_claimed_anew(tmp_path):
    """No call begins later than `hold` after its claim, so a waiting attempt never takes a live one for lost."""
    book, made, begun = ledger.Ledger(f"file://{tmp_path}", "m", patience=0.2, settle=0.01), [], {}
    put = book._put
    book._put = lambda path, data: (begun.__setitem__(path.split("_claims-")[1].split("/")[0], time.monotonic()) if "_claims-" in path else None, put(path, data))

    def call(d):
        made.append((d, time.monotonic() - begun[d]))
        time.sleep(0.08)
        return d

    assert [d for d, reply, _ in book.each([f"{i:04d}" for i in range(20)], "me", call) if d == reply] == [d for d, _ in made]
    assert len(made) == 20 and max(waited for _, waited in made) <= 0.25


def test_lots_side_by_side(tmp_path):
    made, got = [], []

    def attempt(me, names):
        book = ledger.Ledger(f"file://{tmp_path}", "m")
        got.append({d: r for d, r, _ in book.each(names, me, lambda d: made.append(d) or time.sleep(0.01) or d)})

    names = [f"{i:04d}" for i in range(60)]
    threads = [threading.Thread(target=attempt, args=(f"t{i}", names[:: 1 if i % 2 else -1])) for i in range(4)]
    began = time.monotonic()
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert got == [{d: d for d in names}] * 4 and sorted(made) == names and time.monotonic() - began < 40


def test_claim_of_a_lost_executor(tmp_path):
    (tmp_path / "abc" / "_claims-abcd").mkdir(parents=True)
    (tmp_path / "abc" / "_claims-abcd" / "lost").touch()
    began = time.monotonic()
    assert ledger.Ledger(f"file://{tmp_path}", "m", patience=0.5).once("abcd", "me", lambda: "reply") == "reply"
    assert 0.5 <= time.monotonic() - began < 5
    # once there is a reply, old claims do not matter
    assert ledger.Ledger(f"file://{tmp_path}", "m").once("abcd", "you", lambda: 1 / 0) == "reply"


def test_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    b = ledger.Bucket(2.0, 3.0, lambda: now[0], sleep)
    for _ in range(5):
        b.take()
    assert slept == [0.5, 0.5]
    now[0] += 100
    for _ in range(4):
        b.take()
    assert slept == [0.5] * 3  # no more than the burst is saved up
    ledger.Bucket(None, 1.0, lambda: 1 / 0 if slept is None else 0.0, sleep).take()
    assert slept == [0.5] * 3


RETRY = """
import os, sys, uuid
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from chatvitals.operators import ledger
from chatvitals.sources import named_files
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", folder + "/tmp").getOrCreate()

def make():
    def call(text):
        open(f"{folder}/calls/{text}.{uuid.uuid4().hex}", "w").close()
        if text == "t17" and not os.path.exists(folder + "/died"):
            open(folder + "/died", "w").close()
            os._exit(1)
        return text.upper()
    return call

texts = spark.range(0, 40, 1, 2).select(F.col("id").alias("group_key"), F.concat(F.lit("t"), "id").alias("transcript"))
got = ledger.extract(texts, make, folder + "/book", "m", patience=1.0).collect()
assert sorted((r.group_key, r.reply, r.failure) for r in got) == [(i, f"T{i}", None) for i in range(40)]

def pieces(frames):
    for f in frames:
        yield f
        if 7 in set(f["group_key"]) and not os.path.exists(folder + "/died again"):
            open(folder + "/died again", "w").close()
            os._exit(1)

rows = texts.mapInPandas(pieces, texts.schema).select(F.concat(F.lit("f"), "group_key").alias("file"), F.col("transcript").alias("data"))
named_files.write(rows, folder + "/out")
spark.stop()
"""


def test_a_killed_worker(tmp_path):
    """A worker that dies during its 18th call: the task runs again, and of the finished calls none is made twice.  The sink's task dies, too."""
    (tmp_path / "calls").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    called = [n.split(".")[0] for n in os.listdir(tmp_path / "calls")]
    assert sorted(called) == sorted([f"t{i}" for i in range(40)] + ["t17"])
    assert (tmp_path / "died again").exists()
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")} == {"_SUCCESS": ""} | {f"f{i}": f"t{i}" for i in range(40)}


def test_command_line_keeps_a_ledger(spark, tmp_path, capsys):
    from chatvitals.plans import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2025.09.05 星期五\n09:00\tAmy\t我要退款，可以嗎？\n", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("2025.09.05 星期五\n09:00\tAmy\t早安\n", encoding="utf-8")
    (tmp_path / "staff").write_text("Bob\n")
    shown = []
    for make in ("chatvitals.sources.adapters:asking_lines", "chatvitals.sources.adapters:asking_lines"):
        assert cli.main(["--conversations", str(tmp_path / "in"), "--employees", str(tmp_path / "staff"), "--now", "2025-09-05T17:00", "--llm", make, "--llm-ledger", str(tmp_path / "book"), "--llm-per-minute", "6000"]) == 0
        shown.append(capsys.readouterr().out.split("\n", 5)[5])
    assert "[question] 我要退款，可以嗎？" in shown[0] and shown[0] == shown[1]
    # b is not gated, so it was never sent
    assert [r.model for r in ledger.entries(spark, str(tmp_path / "book")).collect()] == ["chatvitals.sources.adapters:asking_lines"]


def test_unknown_fields_are_kept(spark):
    from chatvitals.operators import issues

    replies = ['{"issues": [{"summary": "s", "z": null, "a": {"b": [1, "x"]}}, {"summary": "t"}], "more": 1}', 'so: {"issues": [{"status": "resolved", "é": 0.5}]}', "{broken}", '{"issues": []}', None]
    found, status = issues.parse_replies(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "group_key long, reply string"))
    got = sorted((r.group_key, r.issue_ord, r.other) for r in found.withColumn("other", issues.other_fields()).collect())
    assert [(k, o, json.loads(x) if x else None) for k, o, x in got] == [(0, 0, {"a": {"b": [1, "x"]}, "z": None}), (0, 1, None), (1, 0, {"é": 0.5})]
    assert sorted(r.group_key for r in status.filter("error is not null").collect()) == [2, 4]
