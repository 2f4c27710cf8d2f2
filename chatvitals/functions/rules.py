"""Dialogue act, sentiment and escalation of a message, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Vitals
from .text import any_match, strip


def dialogue_act(text: Column, sticker: Column, image: Column, cfg: Vitals = Vitals()) -> Column:
    """The first rule set that matches names the act."""
    t = strip(text)
    return (
        F.when(sticker | image, "ack")
        .when(t == "", "chit_chat")
        .when(any_match(t, cfg.ack), "ack")
        .when(any_match(t, cfg.question), "question")
        .when(any_match(t, cfg.request), "request")
        .when(any_match(t, cfg.complaint), "report")
        .when(any_match(t, cfg.chit_chat), "chit_chat")
        .otherwise("answer")
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a filter pulls in what a column is made of, and would compute it again wherever the column stands, in a loop each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hits(text: Column, words) -> Column:
    # a loop over a constant array: as a sum of tests it outgrows a generated method where a filter repeats it
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)))


def sentiment(text: Column, cfg: Vitals = Vitals()) -> Column:
    """(positive - negative) / (positive + negative) over list entries that occur; 0 if none does.  An entry listed twice counts twice."""
    hits = _bound(text, lambda t: F.struct(_hits(t, cfg.negative).alias("neg"), _hits(t, cfg.positive).alias("pos")))
    ratio = lambda h: F.try_divide((h["pos"] - h["neg"]).cast("double"), (h["pos"] + h["neg"]).cast("double"))
    return F.coalesce(_bound(hits, ratio), F.lit(0.0))


def escalation(text: Column, cfg: Vitals = Vitals()) -> Column:
    return _bound(text, lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in cfg.escalation), F.lit(False)))


def enrich(messages: DataFrame, cfg: Vitals = Vitals()) -> DataFrame:
    """Adds dialogue_act, sentiment and is_escalation_marker."""
    t = F.col("text")
    return messages.withColumns({"dialogue_act": dialogue_act(t, F.col("is_sticker"), F.col("is_image"), cfg), "sentiment": sentiment(t, cfg), "is_escalation_marker": escalation(t, cfg)})
