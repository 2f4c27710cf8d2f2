"""Labels, colors and texts that go with the numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mood(ratio: Column) -> Column:
    return F.when(ratio >= 0.5, "情緒極度異常").when(ratio >= 0.3, "情緒明顯負面").when(ratio >= 0.1, "情緒略顯不穩").otherwise("正常")


def mood_shown(ratio: Column) -> Column:
    return F.when(ratio >= 0.1, F.concat(F.lit("⚠️ "), mood(ratio))).otherwise(mood(ratio))


def slope(value: Column) -> Column:
    return F.when(value > 0.5, "↑ 上升（對話趨複雜）").when(value > 0.1, "↗ 緩升").when(value >= -0.1, "→ 穩定").otherwise("↘ 收斂（對話趨專一）")


def printed(value: Column, digits: int) -> Column:
    """A number as C's printf shows it with so many digits: its binary value decides, not its shortest decimals; true ties go to the even digit, and what
    rounds to zero from below keeps its sign."""
    unit, size = float(10**digits), F.abs(value.cast("double"))
    head = size.cast("float").cast("double")  # products of either half with the unit are exact
    down = F.floor(size * unit).cast("double")
    over = (head * unit - (down + 0.5)) + (size - head) * unit
    up = F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1.0).otherwise(0.0)
    return F.when(size < 2.0**40, F.signum(value.cast("double")) * ((down + up) / unit)).otherwise(value.cast("double"))


def _number(form: str, value: Column, digits: int = 0) -> Column:
    """A number in a text."""
    return F.format_string(form, printed(value, digits))


# The report's texts.
def trend_text(slope: Column) -> Column:
    text = F.when(slope > 0.5, "語義熵在對話後段明顯上升（slope=%s），對話主題持續擴散或情緒複雜化。").when(slope > 0.1, "語義熵略有上升（slope=%s），對話內容輕微多元化，可持續觀察。")
    text = text.when(slope >= -0.1, "語義熵維持穩定（slope=%s），對話聚焦、話題一致。").otherwise("語義熵在後段下降（slope=%s），對話收斂至特定主題。")
    return F.replace(text, F.lit("%s"), _number("%+.2f", slope, 2))


def trend_color(slope: Column) -> Column:
    return F.when(slope > 0.5, "red").when(slope > 0.1, "amber").when(slope >= -0.1, "green").otherwise("blue")


def latency_insight(p90: Column, severity: Column) -> Column:
    head = F.concat(F.lit("回應延遲 P90 反映業務時間內團隊對客戶提問的回應速度。P90 越低代表 90% 的問題能在更短時間內被接收到回應。目前 P90 = "), _number("%.0f", p90), F.lit(" 分鐘，"))
    return F.concat(head, F.when(severity < 0.35, "屬於優良水準，無需特別關注。").otherwise("已超過警示線，建議提升值班頻率。"))


def mood_insight(severity: Column) -> Column:
    return F.concat(F.lit("負面情緒指標擷取客戶近 24 小時訊息中的負面語氣詞彙比例。"), F.when(severity >= 0.35, "目前比例偏高，建議主動關懷客戶，確認核心訴求是否已被理解。").otherwise("目前情緒正常，持續維持良好溝通即可。"))


def escalation_note(fracs: Column) -> Column:
    """Where in the conversation escalations stand; empty without any."""
    places = F.array_join(F.transform(fracs, lambda f: F.concat(percent_trunc(f).cast("string"), F.lit("%"))), "、")
    return F.when(F.size(fracs) > 0, F.concat(F.lit("  升級詞出現於對話 "), places, F.lit(" 處（圖中紅色虛線）。"))).otherwise("")


def correlation_note(correlated: Column) -> Column:
    return F.when(correlated, "  熵峰值與升級事件高度吻合，顯示升級前後對話出現明顯語義擴散。").otherwise("")


def severity_color(value: Column) -> Column:
    return F.when(value >= 0.7, "red").when(value >= 0.35, "amber").otherwise("green")


def status(tripwire: Column, composite: Column, watch: float = 0.15) -> Column:
    return F.when(tripwire, "紅旗").when(composite >= watch, "關注").otherwise("正常")


def issue_icon(state: Column) -> Column:
    return F.when(state == "resolved", "✅").otherwise("🔴")


def issue_tag(state: Column) -> Column:
    return F.when(state.isin("unresolved", "unclear"), "待處理").otherwise("已解決")


def issue_type(kind: Column) -> Column:
    return F.when(kind == "question", "問題").when(kind == "request", "請求").when(kind == "complaint", "投訴").when(kind == "report", "回報").otherwise(kind)


def percent_trunc(fraction: Column) -> Column:
    return (fraction * 100).cast("int")


def follow_up_flags(i1: Column, i2: Column, i4: Column) -> Column:
    """Which indicators a follow-up names, joined; composite if none."""
    found = F.array_compact(F.array(F.when(i2 >= 0.5, "I2"), F.when(i1 >= 0.3, "I1"), F.when(i4 >= 0.3, "I4")))
    return F.when(F.size(found) > 0, F.array_join(found, "、")).otherwise("composite")
