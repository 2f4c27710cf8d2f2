import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatvitals.plans import cli, report
from chatvitals.sources import named_files


def _files(folder):
    return {n: (folder / n).read_bytes() for n in os.listdir(folder)}


def test_pieces_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 7).select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.concat(F.col("id").cast("string"), F.lit(",")).alias("data"), "id")
    rows = rows.unionByName(spark.createDataFrame([("empty é.txt", None, 0)], "file string, data string, id long"))
    named_files.write(named_files.clustered(rows, "id"), str(tmp_path / "out"))
    assert _files(tmp_path / "out") == {"_SUCCESS": b"", "empty é.txt": b""} | {f"f{k}": "".join(f"{i}," for i in range(k, 3000, 5)).encode() for k in range(5)}


def test_empty_table(spark, tmp_path):
    named_files.write(spark.createDataFrame([], "file string, data binary"), str(tmp_path / "out"))
    assert _files(tmp_path / "out") == {"_SUCCESS": b""}


def test_replacing(spark, tmp_path):
    one = lambda data: spark.createDataFrame([("a", data)], "file string, data string")
    where = str(tmp_path / "out")
    named_files.write(one("old"), where)
    with pytest.raises(Exception, match="is there already"):
        named_files.write(one("new"), where)
    assert _files(tmp_path / "out") == {"_SUCCESS": b"", "a": b"old"}
    named_files.write(one("new"), where, replace=True)
    assert _files(tmp_path / "out") == {"_SUCCESS": b"", "a": b"new"}


@pytest.mark.parametrize("name", [None, "", "a/b", "../a", ".a", "_a"])
def test_bad_names_leave_nothing(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a file's name"):
        named_files.write(spark.createDataFrame([("fine", b"1"), (name, b"2")], "file string, data binary").coalesce(1), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or _files(tmp_path / "out") == {}


@pytest.mark.parametrize("replace", [False, True])
def test_scattered_rows_fail(spark, tmp_path, replace):
    apart = spark.range(0, 2, 1, 2).select(F.lit("a").alias("file"), F.lit(b"1").alias("data"))
    with pytest.raises(Exception, match="two partitions write 'a'"):
        named_files.write(apart, str(tmp_path / "out"), replace)
    with pytest.raises(Exception, match="do not lie together"):
        named_files.write(spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "file string, data binary").coalesce(1), str(tmp_path / "out"), replace)
    assert _files(tmp_path / "out") == {}


@pytest.fixture(scope="module")
def chats(tmp_path_factory):
    d = tmp_path_factory.mktemp("chats")
    (d / "in").mkdir()
    said = ["請問這週可以完工嗎？", "麻煩傳一下報價", "我要退款，太誇張", "hello <b>there</b>", "品質不太好", "覺得還不錯", "我要投訴"]
    for n in range(7):
        (d / "in" / f"{n}.txt").write_text("2025.09.05 星期五\n" + "".join(f"{9 + k:02d}:0{n}\tAmy\t{t}\n" for k, t in enumerate(said[n:] + said[: n // 2])), encoding="utf-8")
    (d / "staff").write_text("Bob\n")
    return d


def test_pages_are_the_one_page_in_parts(spark, chats, tmp_path):
    at = datetime(2025, 9, 5, 18)
    ranked, messages, _, _ = cli.run(spark, str(chats / "in"), str(chats / "staff"), datetime(2025, 9, 5, 17))
    whole = open(report.write_html(report.report_blocks(messages, ranked), report.report_texts(ranked), str(tmp_path / "r.html"), at=at), encoding="utf-8").read()
    report.write_pages(messages, ranked, str(tmp_path / "pages"), at=at, per_index=3)
    pages = {n: d.decode() for n, d in _files(tmp_path / "pages").items() if n != "_SUCCESS"}
    assert sorted(pages) == [*(f"group-{r:09d}.html" for r in range(1, 8)), "index-000001.html", "index-000002.html", "index.html"]
    body = lambda page: page.split("</header>")[1].split("<footer>")[0]
    assert body(whole).split("<hr>")[2:] == [body(pages[f"group-{r:09d}.html"]).removeprefix("<hr>") for r in range(1, 8)]
    # the index: every group once, in order, linked; further on than the cards
    rows = "".join(body(pages[n]) for n in ("index.html", "index-000001.html", "index-000002.html"))
    at_rank = [rows.index(f"<a href='group-{r:09d}.html'>#{r}</a>") for r in range(1, 8)]
    assert at_rank == sorted(at_rank) and rows.count("total: <b>7</b>") == 1
    assert "第 4 頁" in pages["group-000000001.html"] and "href='index-000001.html'" in pages["group-000000004.html"] and "href='index-000001.html'" in pages["index.html"]


def test_command_line_writes_pages(spark, chats, tmp_path, capsys):
    assert cli.main(["--conversations", str(chats / "in"), "--employees", str(chats / "staff"), "--now", "2025-09-05T17:00", "--report", "--pages", "--report-dir", str(tmp_path)]) == 0
    (folder,) = os.listdir(tmp_path)
    assert folder.startswith("triage_report_") and {"index.html", "_SUCCESS", "group-000000007.html"} <= set(os.listdir(tmp_path / folder))
    assert folder in capsys.readouterr().out
