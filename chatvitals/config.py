"""All thresholds, weights, hours and rule sets in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Rule patterns and word lists (searched anywhere in the stripped text, in this order).
ACK = (
    r"^(好|ok|OK|收到|了解|知道了|沒問題|沒事|好的|好哦|嗯|恩|是|是的|收|ㄟ好)[!！。\s]*$",
    r"^(感謝|謝謝|感恩|謝)[!！。\s]*$",
    r"^好[，,]?(麻煩|辛苦|感謝|謝).{0,15}$",
    r"👍",
)
QUESTION = (
    r"[嗎呢？?]$",
    r"^是否",
    r"^可以.{0,10}[嗎？?]",
    r"^有沒有",
    r"^請問",
    r"^能不能",
    r"可以嗎",
    r"方便嗎",
    r"好嗎",
    r"對嗎",
    r"這樣可以",
)
REQUEST = (
    r"可以.{0,15}(給|提供|傳|發|做|改|幫)",
    r"(給|幫|請).{0,10}(我|一下)",
    r"(需要|想要|希望).{0,15}(可以|能)",
    r"麻煩",
    r"勞駕",
)
COMPLAINT = (
    r"(太小|太大|不夠|不對|不好|不滿|有問題)",
    r"(覺得|感覺).{0,10}(不|沒)",
)
CHIT_CHAT = (
    r"^(早安|晚安|哈哈|😂|🥹|🙌|貼圖)[!！。\s]*$",
    r"颱風",
)
NEGATIVE = (
    "哭哭", "失望", "不滿", "不滿意", "不愉快", "不開心", "遺憾", "可惜", "生氣", "憤怒", "不耐煩", "抓狂", "崩潰", "心寒", "不好", "太小", "太大", "太貴", "不夠", "不對", "不合理", "不專業", "太誇張",
    "離譜", "差勁", "有問題", "出問題", "品質差", "不符合", "無法接受", "難以接受", "不可以接受", "無法忍受", "難以相信", "不相信", "不信任", "信任度", "承諾跳票", "一再", "一直", "每次都", "說好", "說不定",
    "交代", "向董事會", "向上面", "嚴重落後", "進度落後", "一再延誤", "一再延期", "遲遲", "久等", "態度", "沒有回應", "都沒有人", "沒人理", "退費", "退款", "退訂", "投訴", "換人", "不合理", "困擾", "麻煩",
    "擔心", "疑慮", "拍謝", "抱歉", "對不起",
)
POSITIVE = (
    "感謝", "謝謝", "感恩", "好的", "沒問題", "完美", "很好", "讚", "棒", "期待", "開心", "順利", "👍", "🙌", "🥹",
)
ESCALATION = (
    "退費", "退錢", "退款", "退訂金", "退訂", "投訴", "換人", "找你主管", "找你老闆", "找主管", "找老闆", "跟你主管談", "跟你老闆談", "解約", "取消合約", "告你", "法院", "消保", "消費者保護",
)
STICKER = ("貼圖", "[貼圖]", "Sticker")
IMAGE = ("圖片", "[圖片]", "Photo", "Image")
SYSTEM_SENDERS = ("", "系統訊息")


@dataclass(frozen=True)
class Vitals:
    """Everything that tunes an analysis; the defaults are the compatible ones."""

    merge_seconds: int = 60
    lane_rows: int = 200_000  # groups of more rows are cut into lanes of about as many; changes the work, not the result
    entropy_window: int = 5
    service_open: int = 9
    service_close: int = 18
    service_days: int = 5  # from Monday on
    i1_warn: float = 30.0
    i1_crit: float = 360.0
    i2_warn: float = 120.0
    i2_crit: float = 480.0
    i2_cap_days: int = 4
    i3_warn: float = 60.0
    i3_crit: float = 480.0
    i4_hours: int = 72
    i5_hours: int = 24
    negative_below: float = -0.1
    tripwire_age: float = 480.0
    tripwire_score: float = 0.95
    weights: dict = field(default_factory=lambda: {"i1": 0.35, "i2": 0.20, "i3": 0.15, "i4": 0.30})
    gate: float = 0.3
    watch: float = 0.15
    ack: tuple = ACK
    question: tuple = QUESTION
    request: tuple = REQUEST
    complaint: tuple = COMPLAINT
    chit_chat: tuple = CHIT_CHAT
    negative: tuple = NEGATIVE
    positive: tuple = POSITIVE
    escalation: tuple = ESCALATION
    sticker: tuple = STICKER
    image: tuple = IMAGE
    system_senders: tuple = SYSTEM_SENDERS
