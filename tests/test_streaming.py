from datetime import datetime

from chatvitals.streaming.exports import watch

CHAT = "[LINE] {}\n2025.09.05 星期五\n09:00\tAmy\t請問可以嗎？\n09:05\tBob\t好的\n"


def test_each_file_is_scored_once(spark, tmp_path):
    chats, seen = tmp_path / "in", []
    chats.mkdir()
    (tmp_path / "staff").write_text("Bob\n")

    def run():
        watch(spark, str(chats), str(tmp_path / "staff"), lambda: datetime(2025, 9, 5, 17), lambda df, n: seen.extend((r["group_id"], r["i2_p90_min"]) for r in df.collect()), str(tmp_path / "state"), once=True).awaitTermination()

    (chats / "a.txt").write_text(CHAT.format("A"), encoding="utf-8")
    run()
    (chats / "b.txt").write_text(CHAT.format("B"), encoding="utf-8")
    run()
    assert seen == [("A", 5.0), ("B", 5.0)]
