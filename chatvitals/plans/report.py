"""Sinks: the ranked text report, report blocks, an HTML page and the status log."""

from __future__ import annotations

import html
import json
import os
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Vitals
from ..functions import labels
from ..operators import entropy, indicators, issues
from ..sources import named_files
from .analysis import once, overview, overview_names


# The lines of the text report, in order; (order, text, columns in it, column that has to hold).
LINES = (
    (0, "\n#%d  %s  %s", ("rank", "group_id", "flag"), None),
    (1, "    綜合分數: %.3f", ("composite",), None),
    (2, "    I1 未回應提問: severity=%.2f  開放題數=%d  最老=%.0f分", ("i1_severity", "i1_open_questions", "i1_oldest_age_min"), None),
    (3, "    I2 回應延遲P90: severity=%.2f  P90=%.0f分", ("i2_severity", "i2_p90_min"), None),
    (4, "    I3 最老未解議題: severity=%.2f  開放=%d個  最老=%.0f分", ("i3_severity", "i3_open_issues", "i3_oldest_age_min"), "has_issues"),
    (6, "    I4 客戶負面情緒: severity=%.2f  負面比=%.1f%%  [%s]", ("i4_severity", "neg_percent", "mood_shown"), None),
    (7, "    I5 近24h訊息量: %d", ("i5_msg_count_24h",), None),
    (8, "    I6 語義熵: mean=%.2fbits  slope=%+.2f  峰值@對話%d%%  [%s]", ("i6_mean_entropy", "i6_entropy_slope", "peak_pct", "slope_label"), "has_series"),
)
# The page's texts of a group, in order; (section, order, text, columns in it, column that has to hold).
TEXTS = (
    ("bars", 0, "I1 未回應提問  severity %.2f  |  最老 %.0f 分鐘", ("i1_severity", "i1_oldest_age_min"), None),
    ("bars", 1, "I2 回應延遲  severity %.2f  |  P90 = %.0f 分鐘", ("i2_severity", "i2_p90_min"), None),
    ("bars", 2, "I4 負面情緒  severity %.2f  |  負面比 %.1f%%", ("i4_severity", "neg_percent"), None),
    ("bars", 3, "綜合分數  composite %.3f", ("composite",), None),
    ("latency", 0, "P90 延遲：%.0f 分鐘（警示線 120 分 / 臨界線 480 分）", ("i2_p90_min",), None),
    ("latency", 1, "%s", ("latency_insight",), None),
    ("sentiment", 0, "近 24 小時客戶訊息中，%.1f%% 帶有負面詞彙（severity = %.2f）。", ("neg_percent", "i4_severity"), None),
    ("sentiment", 1, "%s", ("mood_insight",), None),
    ("entropy", 0, "字元 bigram Shannon 熵（bits）隨對話進展的變化。  均值 %.2f bits，熵峰值出現於對話 %d%% 處。", ("i6_mean_entropy", "peak_pct"), "drawn"),
    ("entropy", 1, "%s", ("trend_insight",), "drawn"),
    ("issues", 0, "共 %d 個議題：%d 個待處理、%d 個已解決。最老未解議題年齡：%.0f 分鐘。", ("n_issues", "n_open", "n_resolved", "i3_oldest_age_min"), "has_issues"),
    ("issues", 1, "共 %d 項議題尚未定案。建議在下次客戶接觸前整理待確認清單，逐項確認後關閉。", ("n_open",), "has_issues"),
    ("action", 0, "【今日跟進】%s｜%s，建議今日內主動聯繫客戶確認狀態。", ("group_id", "follow_up_text"), "watched"),
)
FOLLOW_UPS = (("i2_severity", 0.5, "回應延遲 P90=%.0f 分", ("i2_p90_min",)), ("i1_severity", 0.3, "未回覆提問 %d 個（最老 %.0f 分）", ("i1_open_questions", "i1_oldest_age_min")), ("i4_severity", 0.3, "負面情緒比 %.0f%%", ("neg_percent",)))
FOLLOW_UP_ELSE = ("綜合分數 %.2f", ("composite",))
RED_BOX = "【立即處理】{}｜已觸發升級詞彙（退款／投訴／找主管），請在 1 小時內主管介入確認，評估是否需要電話溝通。"
OK_BOX = "【維持現狀】{}｜指標正常，按原節奏推進即可。"
PAGE_HEAD, PAGE_TIME = "LINE 群組健康度 Triage 報告", "產生時間：{:%Y-%m-%d %H:%M}"
PAGE_NUMBER, INDEX = "第 {} 頁", "總覽"
AXIS = ("對話開始", "對話結尾")
ISSUE_LINE, REASON_LINE = (5, "       %s [%s] %s"), (9, "    ⚠️  %s")
TITLE, BAR = "  LINE 群組健康度 Triage 報表  |  {:%Y-%m-%d %H:%M}", "=" * 60


def _line(text: str, columns) -> Column:
    """A line with numbers in it, as C's printf shows them."""
    digits = [int(d) if d else None for d in re.findall(r"%(?:\+?\.(\d)f|[ds])", text)]
    return F.format_string(text, *(labels.printed(F.col(c), d) if d is not None else F.col(c) for c, d in zip(columns, digits)))


def report_lines(ranked: DataFrame, found: DataFrame | None = None, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(rank, ord, sub, line): the text report's lines of every group, from ranked metrics and issues."""
    shown = labelled(ranked, cfg)
    some = found.select(key).distinct().withColumn("has_issues", F.lit(True)) if found is not None else shown.select(key).limit(0).withColumn("has_issues", F.lit(True))
    shown = shown.join(some, key, "left").withColumn("has_issues", F.coalesce("has_issues", F.lit(False)))
    lines = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(0).alias("sub"), (F.when(F.col(when), _line(text, cols)) if when else _line(text, cols)).alias("line")) for o, text, cols, when in LINES))
    reasons = F.transform("tripwire_reasons", lambda r, i: F.struct(F.lit(REASON_LINE[0]).alias("ord"), i.alias("sub"), F.format_string(REASON_LINE[1], r).alias("line")))
    out = shown.select("rank", F.explode(F.concat(lines, reasons)).alias("l")).select("rank", "l.*").filter("line is not null")
    if found is None:
        return out
    kind, summary = F.coalesce("type", F.lit("")), F.coalesce(F.substring("summary", 1, 50), F.lit(""))
    line = F.format_string(ISSUE_LINE[1], labels.issue_icon(F.col("status")), kind, summary)
    return out.unionByName(found.join(shown.select(key, "rank"), key).select("rank", F.lit(ISSUE_LINE[0]).alias("ord"), F.col("issue_ord").alias("sub"), line.alias("line")))


def labelled(ranked: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    c = F.col
    return ranked.withColumns({
        "mood": labels.mood(c("i4_neg_ratio")), "slope_label": labels.slope(c("i6_entropy_slope")), "status": labels.status(c("tripwire"), c("composite"), cfg.watch), "color": labels.severity_color(c("composite")),
        "flag": F.when(c("tripwire"), "🚨 [TRIPWIRE]").otherwise(""), "mood_shown": labels.mood_shown(c("i4_neg_ratio")), "neg_percent": c("i4_neg_ratio") * 100, "has_series": c("i6_points") > 0,
        "peak_pct": labels.percent_trunc(c("i6_peak_entropy_frac")), "follow_up": labels.follow_up_flags(c("i1_severity"), c("i2_severity"), c("i4_severity")),
    })


def report_texts(ranked: DataFrame, found: DataFrame | None = None, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(rank, section, ord, text): what the page says of each group, from ranked metrics and issues."""
    shown = insights(labelled(ranked, cfg)).withColumns({"drawn": F.col("i6_points") >= 5, "watched": ~F.col("tripwire") & (F.col("composite") >= cfg.watch)})
    if found is None:
        shown = shown.withColumns({"n_issues": F.lit(0), "n_open": F.lit(0), "n_resolved": F.lit(0)})
    else:
        counts = found.groupBy(key).agg(F.count("*").alias("n_issues"), F.count_if(issues.is_open()).alias("n_open"), F.count_if(F.col("status") == "resolved").alias("n_resolved"))
        shown = shown.join(counts, key, "left").fillna(0, ["n_issues", "n_open", "n_resolved"])
    flags = F.array_compact(F.array(*(F.when(F.col(c) >= least, _line(text, columns)) for c, least, text, columns in FOLLOW_UPS)))
    shown = shown.withColumns({"has_issues": F.col("n_issues") > 0, "follow_up_text": F.when(F.size(flags) > 0, F.array_join(flags, "、")).otherwise(_line(*FOLLOW_UP_ELSE))})
    texts = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(o).alias("ord"), (F.when(F.col(when), _line(text, columns)) if when else _line(text, columns)).alias("text")) for section, o, text, columns, when in TEXTS))
    return shown.select("rank", F.explode(texts).alias("t")).select("rank", "t.*").filter("text is not null")


def text_report(ranked: DataFrame, rendered_at: datetime | None = None, found: DataFrame | None = None, cfg: Vitals = Vitals()) -> str:
    """The whole report; its lines stream through the driver in order."""
    rows = report_lines(ranked, found, cfg).orderBy("rank", "ord", "sub").toLocalIterator()
    return "\n".join([BAR, TITLE.format(rendered_at or datetime.now()), BAR, *(r["line"] for r in rows), "\n" + BAR])


def report_blocks(messages: DataFrame, ranked: DataFrame, found: DataFrame | None = None, cfg: Vitals = Vitals(), key: str = "group_key") -> DataFrame:
    """(rank, section, ord, kind, payload): what a renderer needs, in order; rank 0 is the overview.

    Payloads are JSON of plain numbers and texts; sections appear as the report has them (a chart from five points on)."""
    messages, shown = once(messages), once(insights(labelled(ranked, cfg)))
    ranked = shown
    to_json = lambda *c: F.to_json(F.struct(*c))
    place = shown.select(key, "rank")
    series = once(entropy.entropy_series(messages, cfg, key).filter("n_text >= 5"))
    blocks = [
        overview(ranked, cfg).select(F.lit(0).alias("rank"), F.lit("cards").alias("section"), F.lit(0).alias("ord"), F.lit("overview").alias("kind"), to_json("total", "red", "watch", "ok").alias("payload")),
        shown.select(F.lit(0).alias("rank"), F.lit("ranking").alias("section"), F.col("rank").alias("ord"), F.lit("row").alias("kind"), to_json("group_id", "composite", "i1_severity", "i2_severity", "i4_severity", "status", "color").alias("payload")),
        overview_names(shown, cfg).select(F.lit(0).alias("rank"), F.when(F.col("kind") == "red", "actions").otherwise("actions-ok").alias("section"), F.col("rank").alias("ord"), "kind", to_json("name").alias("payload")),
        shown.filter(f"not tripwire and composite >= {cfg.watch}").select(F.lit(0).alias("rank"), F.lit("actions-watch").alias("section"), F.col("rank").alias("ord"), F.lit("watch").alias("kind"), to_json("group_id", "follow_up", "i2_p90_min", "i1_open_questions", "i1_oldest_age_min", "i4_neg_ratio", "composite").alias("payload")),
        shown.select("rank", F.lit("a-header").alias("section"), F.lit(0).alias("ord"), F.lit("header").alias("kind"), to_json("group_id", "composite", "tripwire", "color").alias("payload")),
        shown.select("rank", F.posexplode("tripwire_reasons").alias("ord", "reason")).select("rank", F.lit("b-tripwire").alias("section"), "ord", F.lit("reason").alias("kind"), to_json("reason").alias("payload")),
        shown.select("rank", F.lit("c-metrics").alias("section"), F.lit(0).alias("ord"), F.lit("cards").alias("kind"), to_json("i1_open_questions", "i1_severity", "i1_oldest_age_min", "i2_p90_min", "i2_severity", "i4_neg_ratio", "i4_severity", "i5_msg_count_24h").alias("payload")),
        shown.select("rank", F.lit("d-latency").alias("section"), F.lit(1).alias("ord"), F.lit("insight").alias("kind"), to_json("latency_insight").alias("payload")),
        shown.select("rank", F.lit("e-sentiment").alias("section"), F.lit(99).alias("ord"), F.lit("insight").alias("kind"), to_json("mood_insight").alias("payload")),
        indicators.latency_example(messages, key).join(place, key).select("rank", F.lit("d-latency").alias("section"), F.lit(0).alias("ord"), F.lit("example").alias("kind"), to_json("ts", "text", "reply_ts", "reply_text", "minutes").alias("payload")),
        indicators.negative_examples(messages, cfg, key).join(place, key).select("rank", F.lit("e-sentiment").alias("section"), "ord", F.lit("example").alias("kind"), to_json("ts", "text").alias("payload")),
        entropy.chart_points(series, key).join(place, key).select("rank", F.lit("f-entropy").alias("section"), F.col("pos").alias("ord"), F.lit("point").alias("kind"), to_json("x", "y").alias("payload")),
        shown.filter("i6_points >= 5").join(entropy.chart_stats(series, key), key).select("rank", F.lit("f-entropy").alias("section"), F.lit(-1).alias("ord"), F.lit("trend").alias("kind"), to_json("e_min", "e_max", "i6_mean_entropy", "i6_entropy_slope", "peak_pct", "slope_label", "trend_color", "trend_insight", "i6_escalation_fracs", correlated().alias("correlated")).alias("payload")),
    ]
    if found is not None:
        meta = issues.issue_order(found).join(place, key).withColumns({"type_label": labels.issue_type(F.col("type")), "tag": labels.issue_tag(F.col("status")), "raised": F.substring("raised_at", 1, 10), "evidence": F.substring("resolution_evidence", 1, 40), "other": issues.other_fields() if "fields" in found.columns else F.lit(None).cast("string")})
        blocks.append(meta.select("rank", F.lit("g-issues").alias("section"), (F.col("shown_ord") * (1 << 20) + F.col("issue_ord")).alias("ord"), F.lit("issue").alias("kind"), to_json(F.coalesce("summary", F.lit("（無摘要）")).alias("summary"), "type_label", "tag", "raised", "evidence", "other").alias("payload")))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def insights(shown: DataFrame) -> DataFrame:
    """Adds the report's texts on latency, mood and trend (null below five points) and the trend's color."""
    slope, drawn = F.col("i6_entropy_slope"), F.col("i6_points") >= 5
    trend = F.concat(labels.trend_text(slope), labels.escalation_note(F.col("i6_escalation_fracs")), labels.correlation_note(correlated()))
    return shown.withColumns({
        "latency_insight": labels.latency_insight(F.col("i2_p90_min"), F.col("i2_severity")), "mood_insight": labels.mood_insight(F.col("i4_severity")),
        "trend_insight": F.when(drawn, trend), "trend_color": F.when(drawn, labels.trend_color(slope)),
    })


def correlated():
    """Escalations and entropy peak lie close together."""
    fracs = F.col("i6_escalation_fracs")
    mean = F.aggregate(fracs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(fracs), F.lit(0))
    return F.coalesce((F.col("i6_peak_entropy_frac") > 0) & (F.abs(F.col("i6_peak_entropy_frac") - mean) < 0.2), F.lit(False))


COLORS = {"red": "#c0392b", "amber": "#d68910", "green": "#1e8449", "blue": "#2e6da4"}


def _chart(points: list[tuple[float, float]], escalations: list[float], low: float, high: float, mean: float) -> str:
    """The entropy line with its mean (gray, dashed), escalations (red, dashed), and what its ends and heights stand for."""
    y = lambda v: 8 + (1 - v) * 72
    line = " ".join(f"{6 + x * 588:.1f},{y(v):.1f}" for x, v in points)
    middle = y((mean - low) / max(high - low, 0.5))
    marks = "".join(f"<line class='escalation' x1='{6 + x * 588:.1f}' x2='{6 + x * 588:.1f}' y1='8' y2='80' stroke='{COLORS['red']}' stroke-dasharray='2 2'/>" for x in escalations)
    small = "font-size='9' fill='#777'"
    return (
        f"<svg width='660' height='98'><rect x='6' y='8' width='588' height='72' fill='#fff' stroke='#ccc'/><line x1='6' x2='594' y1='{middle:.1f}' y2='{middle:.1f}' stroke='#999' stroke-dasharray='3 3'/>{marks}"
        f"<polyline fill='none' stroke='{COLORS['blue']}' stroke-width='1.5' points='{line}'/><text x='6' y='93' {small}>{AXIS[0]}</text><text x='558' y='93' {small}>{AXIS[1]}</text>"
        f"<text x='598' y='80' {small}>{low:.1f}</text><text x='598' y='16' {small}>{high:.1f} bits</text></svg>"
    )


def _bar(text: str, value: float) -> str:
    color = COLORS["red" if value >= 0.7 else "amber" if value >= 0.35 else "green"]
    return f"<p><svg class='bar' width='270' height='8'><rect width='270' height='8' fill='#ddd'/><rect width='{270 * min(1.0, max(0.0, value)):.1f}' height='8' fill='{color}'/></svg> <span style='color:{color}'>{html.escape(text)}</span></p>"


def page_rows(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(rank, place, kind, payload): blocks and texts in the order in which a page shows them."""
    sections = ("cards", "ranking", "actions", "actions-watch", "actions-ok", "a-header", "b-tripwire", "c-metrics", "bars", "latency", "d-latency", "sentiment", "e-sentiment", "entropy", "f-entropy", "issues", "g-issues")
    place = F.create_map(*(x for i, section in enumerate(sections) for x in (F.lit(section), F.lit(i))))
    shown = blocks.filter(~((F.col("kind") == "insight") | (F.col("section") == "actions-watch"))).select("rank", "section", F.col("ord").cast("long").alias("ord"), "kind", "payload")
    said = texts.select(F.when(F.col("section") == "action", 0).otherwise(F.col("rank")).alias("rank"), F.when(F.col("section") == "action", "actions-watch").otherwise(F.col("section")).alias("section"), F.when(F.col("section") == "action", F.col("rank")).otherwise(F.col("ord")).cast("long").alias("ord"), F.when(F.col("section") == "bars", "bar").otherwise("text").alias("kind"), F.col("text").alias("payload"))
    return shown.unionByName(said).select("rank", F.element_at(place, F.col("section")).alias("place"), "section", "ord", "kind", "payload")


class Page:
    """HTML of page rows that come in order; holds the chart of one group at most.  The next page's rows follow `end`."""

    def __init__(self, title: str, at: datetime, number: int = 1, links: bool = False):
        self.title, self.at, self.number, self.links = title, at, number, links
        self.where, self.values, self.trend, self.names, self.points = None, {}, None, None, []

    def head(self) -> str:
        return f"<!doctype html><meta charset='utf-8'><title>{html.escape(self.title)}</title><body style='font-family:sans-serif;max-width:60em;margin:auto'><header>{PAGE_HEAD}　{PAGE_TIME.format(self.at)}</header>"

    def row(self, b) -> str:
        """b: (rank, section, ord, kind, payload)"""
        payload = b.payload if b.kind in ("text", "bar") else json.loads(b.payload)
        out = ""
        if (b.rank, b.section) != self.where:
            out += self._close() + ("<hr>" if self.where is None or b.rank != self.where[0] else "") + f"<h3>{html.escape(b.section)}</h3>"
            if self.where is not None and b.rank != self.where[0]:
                self.trend = None
            self.where = (b.rank, b.section)
        if b.kind == "point":
            self.points.append((payload["x"], payload["y"]))
            return out
        if b.kind == "bar":
            return out + _bar(payload, self.values.get(("i1_severity", "i2_severity", "i4_severity", "composite")[b.ord], 0.0))
        if b.kind == "text":
            return out + f"<p>{html.escape(payload)}</p>"
        if b.kind in ("red", "ok"):  # names of one box, written as they come
            out += "、" if self.names else "<p>" + (RED_BOX if b.kind == "red" else OK_BOX).split("{}")[0]
            self.names = b.kind
            return out + html.escape(payload["name"])
        if b.kind in ("header", "cards"):
            self.values |= payload
        self.trend = payload if b.kind == "trend" else self.trend
        shown = lambda v: html.escape(f"{v:.3f}" if isinstance(v, float) else str(v))
        link = f"<a href='{group_page(b.ord)}'>#{b.ord}</a> " if self.links and b.kind == "row" else ""
        return out + "<p>" + link + "　".join(f"{html.escape(k)}: <b>{shown(v)}</b>" for k, v in payload.items()) + "</p>"

    def _close(self) -> str:
        out = ""
        if self.names:
            out = (RED_BOX if self.names == "red" else OK_BOX).split("{}")[1] + "</p>"
            self.names = None
        if len(self.points) > 1 and self.trend:
            t = self.trend
            out += _chart(self.points, t["i6_escalation_fracs"], t["e_min"], t["e_max"], t["i6_mean_entropy"])
        self.points = []
        return out

    def end(self) -> str:
        return self._close() + f"<footer>{PAGE_NUMBER.format(self.number)}</footer></body>"


def write_html(blocks: DataFrame, texts: DataFrame, path: str, title: str = "群組健康度報告", at: datetime | None = None) -> str:
    """One page; its rows stream through the driver in order, and only a group's chart is held.  `write_pages` is for many groups."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    page = Page(title, at or datetime.now())
    with open(path, "w", encoding="utf-8") as out:
        out.write(page.head())
        for b in page_rows(blocks, texts).orderBy("rank", "place", "ord").toLocalIterator():
            out.write(page.row(b))
        out.write(page.end())
    return path


def group_page(rank: int) -> str:
    return f"group-{rank:09d}.html"


def index_page(number: int) -> str:
    return f"index-{number:06d}.html" if number else "index.html"


def page_texts(blocks: DataFrame, texts: DataFrame, groups: int, title: str = "群組健康度報告", at: datetime | None = None, per_index: int = 1000) -> DataFrame:
    """(file, data): a page for each group and index pages of per_index groups each, rendered where their rows are; clustered as the sink wants it.

    Pages have numbers through the whole report, index pages first; boxes of names are cut as the index is.  `groups` is their number."""
    at, n_index = at or datetime.now(), max(1, -(-groups // per_index))
    rows = page_rows(blocks, texts)
    of_index = F.when(F.col("section") == "cards", 0).otherwise(F.floor((F.col("ord") - 1) / per_index)).cast("int")
    rows = rows.withColumn("number", F.when(F.col("rank") == 0, of_index).otherwise(F.col("rank") + n_index - 1).cast("int"))
    rows = rows.repartition("number").sortWithinPartitions("number", "rank", "place", "ord").select("number", "rank", "section", "ord", "kind", "payload")

    def render(frames):
        import pandas as pd

        page = None

        def close():
            links = "".join(f" <a href='{index_page(i)}'>{PAGE_NUMBER.format(i + 1)}</a>" for i in (page.number - 2, page.number) if 0 <= i < n_index) if page.links else f" <a href='{index_page((page.number - n_index - 1) // per_index)}'>{INDEX}</a>"
            return page.end().replace("</footer>", links + "</footer>")

        name = lambda p: index_page(p.number - 1) if p.links else group_page(p.number - n_index)
        for frame in frames:
            out: list[tuple[str, bytes]] = []
            for b in frame.itertuples(index=False):
                if page is None or b.number + 1 != page.number:
                    if page is not None:
                        out.append((name(page), close().encode()))
                    page = Page(title, at, b.number + 1, b.number < n_index)
                    out.append((name(page), page.head().encode()))
                out.append((name(page), page.row(b).encode()))
            yield pd.DataFrame(out, columns=["file", "data"])
        if page is not None:
            yield pd.DataFrame([(name(page), close().encode())], columns=["file", "data"])

    return rows.mapInPandas(render, named_files.SCHEMA)


def write_pages(messages: DataFrame, ranked: DataFrame, folder: str, found: DataFrame | None = None, cfg: Vitals = Vitals(), title: str = "群組健康度報告", at: datetime | None = None, per_index: int = 1000) -> str:
    """The report as a folder of pages: index.html and its followers by rank, and a page for each group.  Tasks render and write them; none passes the driver."""
    ranked = once(ranked)
    groups = ranked.agg(F.max("rank")).first()[0] or 0
    return named_files.write(page_texts(report_blocks(messages, ranked, found, cfg), report_texts(ranked, found, cfg), groups, title, at, per_index), folder)


def report_name(folder: str, at: datetime, suffix: str = "html") -> str:
    return os.path.join(folder, f"triage_report_{at:%Y%m%d_%H%M%S}{'.' if suffix else ''}{suffix}")


def file_status(status: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per file: its error, or its score and number of tripwire reasons."""
    return status.join(ranked.select("group_key", "composite", F.size("tripwire_reasons").alias("n_tripwire")), "group_key", "left").select(F.col("group_key").alias("source_file"), F.when(F.col("error").isNull(), "OK").otherwise("ERROR").alias("status"), "error", "n_tripwire", "composite")
