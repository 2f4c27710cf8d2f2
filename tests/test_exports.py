import os
import shutil
from datetime import datetime

import pytest

from chatvitals.plans import cli, report
from chatvitals.sources import exports

CHAT = """[LINE] 群組 A
儲存日期：2025.09.05
08:59\tnobody\ttoo early
2025.09.05 星期五
09:00\tAmy\t請問這週可以完工嗎？
09:01\t系統訊息\tjoined
continuation is lost
09:02\tBob\t貼圖
09:03\tAmy\t我要退款，太誇張
09:04\tAmy\t
10:00\tA\tB\tC
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("chats")
    (d / "a.txt").write_text(CHAT, encoding="utf-8")
    (d / "b empty+.txt").write_text("", encoding="utf-8")
    (d / "c.txt").write_text("2025.13.05 星期五\n09:00\tAmy\thi\n", encoding="utf-8")
    (d / "d.txt").write_bytes(b"\xff\xfe bad")
    (d / "e.txt").write_text("25:00\tAmy\tbefore any date\n2025.09.05 星期五\n09:00\tAmy\tok\n", encoding="utf-8")
    (d / "f.txt").write_text("2025.09.05 星期五\n25:00\t系統訊息\tx\n", encoding="utf-8")
    (d / "skip.md").write_text("no")
    (d / "staff.list").write_text("# staff\nBob\n\n  Bob \n", encoding="utf-8")
    return str(d)


def test_parse(spark, folder):
    files = exports.scan_conversations(spark, folder)
    messages, status = exports.parse(files, exports.load_staff(spark, folder + "/staff.list"))
    got = [(r["sender"], r["role"], r["ts"].strftime("%H:%M"), r["text"], r["is_sticker"], r["msg_id"]) for r in messages.filter("group_key = 'a.txt'").orderBy("seq").collect()]
    assert got == [
        ("Amy", "customer", "09:00", "請問這週可以完工嗎？", False, "群組 A_00001"),
        ("Bob", "staff", "09:02", "", True, "群組 A_00002"),
        ("Amy", "customer", "09:03", "我要退款，太誇張", False, "群組 A_00003"),
        ("A", "customer", "10:00", "B\tC", False, "群組 A_00004"),
    ]
    errors = {r["group_key"]: (r["group_id"], r["error"]) for r in status.collect()}
    assert errors == {"a.txt": ("群組 A", None), "b empty+.txt": ("b empty+", None), "c.txt": ("c", "impossible date or time"), "d.txt": ("d", "not UTF-8"), "e.txt": ("e", None), "f.txt": ("f", "impossible date or time")}


@pytest.mark.parametrize("size", ["64b", "1000b"])
def test_splits_parse_as_whole_files(spark, folder, tmp_path, size):
    long = "[LINE] long\r\n" + "".join(f"2025.{m:02d}.{d:02d} 星期一\n" + "".join(f"{h:02d}:{d:02d}\t{'Bob' if h % 3 else 'Amy é'}\tline {m} {d}\x0b09:00\tAmy\ttail\r" for h in range(9, 9 + d % 9)) for m in range(1, 4) for d in range(1, 29))
    for name in os.listdir(folder):
        shutil.copy(f"{folder}/{name}", tmp_path / name)
    (tmp_path / "long.txt").write_bytes(long.encode())
    staff = exports.load_staff(spark, folder + "/staff.list")
    whole, states = exports.parse(exports.scan_conversations(spark, str(tmp_path)), staff)
    rows = lambda df: sorted((tuple(r[c] for c in whole.columns) for r in df.collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        listed, lines = exports.scan_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        messages, status = exports.parse_splits(listed, lines, staff)
        assert rows(messages) == rows(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert whole.filter("group_id = 'long'").count() > 500
    assert {tuple(r[c] for c in states.columns) for r in status.select(*states.columns).collect()} == {tuple(r) for r in states.collect()}


def test_end_to_end(spark, folder, tmp_path):
    ranked, messages, status, _ = cli.run(spark, folder, folder + "/staff.list", datetime(2025, 9, 5, 17))
    rows = ranked.orderBy("rank").collect()
    assert [r["group_id"] for r in rows] == ["群組 A", "b empty+", "e"]
    assert rows[0]["tripwire"] and rows[0]["composite"] >= 0.95
    text = report.text_report(ranked, datetime(2025, 9, 5, 18))
    assert "#1  群組 A  🚨 [TRIPWIRE]" in text and "升級詞觸發 (msg_id=群組 A_00003)" in text
    page = report.write_html(report.report_blocks(messages, ranked), report.report_texts(ranked), str(tmp_path / "out" / "r.html"))
    shown = open(page, encoding="utf-8").read()
    assert "群組 A" in shown and shown.count("class='bar'") == 12 and "【立即處理】群組 A｜已觸發" in shown and "【維持現狀】b empty+、e｜指標正常" in shown and "警示線 120 分 / 臨界線 480 分" in shown and "產生時間：" in shown
    log = {r["source_file"]: r["status"] for r in report.file_status(status, ranked).collect()}
    assert log["c.txt"] == "ERROR" and log["a.txt"] == "OK"


def test_page_draws_escalations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    said = ["請問這週可以完工嗎？", "麻煩傳一下報價", "我要退款，太誇張", "hello there", "品質不太好", "覺得還不錯", "我要投訴"]
    (tmp_path / "in" / "a.txt").write_text("2025.09.05 星期五\n" + "".join(f"{9 + k:02d}:00\tAmy\t{t}\n" for k, t in enumerate(said)), encoding="utf-8")
    (tmp_path / "staff").write_text("Bob\n")
    ranked, messages, _, _ = cli.run(spark, str(tmp_path / "in"), str(tmp_path / "staff"), datetime(2025, 9, 5, 17))
    shown = open(report.write_html(report.report_blocks(messages, ranked), report.report_texts(ranked), str(tmp_path / "r.html")), encoding="utf-8").read()
    assert shown.count("class='escalation'") == 2 and "stroke-dasharray='3 3'" in shown and " bits</text>" in shown and "對話開始" in shown and shown.count("<polyline") == 1


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        exports.scan_conversations(spark, str(tmp_path))


def test_listing_asks_for_names_at_once(spark, tmp_path, monkeypatch):
    """The driver's calls do not grow with the files; empty and hidden files are listed, directories are not."""
    names = [f"{i:03d}.txt" for i in range(150)] + ["a, b.txt", "c+d %41 é.txt", "[g].txt"]
    for n in names:
        (tmp_path / n).write_text("x" * (len(n) + 1))
    for n in ("empty.txt", "_hidden.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "folder.txt").mkdir()
    (tmp_path / "other.md").write_text("no")
    client, calls = type(spark._sc._gateway._gateway_client), [0]
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda self, *a, **k: (calls.__setitem__(0, calls[0] + 1), send(self, *a, **k))[1])
    listed = exports._listed(spark, str(tmp_path), "*.txt")
    monkeypatch.undo()
    got = [(r.source_file, r.file_ord, r.bytes) for r in listed.orderBy("file_ord").collect()]
    assert got == [(n, i, 0 if n in ("empty.txt", "_hidden.txt") else len(n) + 1) for i, n in enumerate(sorted([*names, "empty.txt", "_hidden.txt"]))]
    assert calls[0] < 450  # 150 files took four each
