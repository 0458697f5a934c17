"""Judgement scores: parsing, multipliers, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highest judgement.
TOP = 9


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def parsed_score(answer: Column) -> Column:
    """0 to 9 from an answer: a JSON number or object (score, rating, relevance), a bare number, a line "score: n"; else null.

    JSON true counts as 1 and fractions are cut. The first of the three keys decides: if it is
    no number, the object is not used.
    """
    text = F.regexp_replace(answer, r"^\s+|\s+$", "")
    number = F.when(text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), text).when(F.lower(text) == "true", "1").when(F.lower(text) == "false", "0")
    keyed = F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in ("score", "rating", "relevance")))
    keyed = F.when(keyed == "true", "1").when(keyed == "false", "0").otherwise(keyed)
    line = F.nullif(F.regexp_extract(text, r"(?im)^\s*score\s*:\s*(-?[0-9]{1,2})\s*$", 1), F.lit(""))
    found = F.coalesce(number.try_cast("double"), keyed.try_cast("double"), line.try_cast("double"))
    return clamp(F.when(found < 0, F.ceil(found)).otherwise(F.floor(found)).cast("int"), 0, TOP).cast("int")


def multiplier(score: Column, low: float = 0.5, high: float = 1.5) -> Column:
    """Linear from ``low`` at 0 to ``high`` at 9."""
    return low + (high - low) * clamp(score.cast("double"), 0.0, float(TOP)) / TOP


def adjusted(base: Column, answer: Column, low: float = 0.5, high: float = 1.5) -> Column:
    """Base times the answer's multiplier, 1 at most; the base itself if no score can be read."""
    return adjusted_by(base, parsed_score(answer), low, high)


def adjusted_by(base: Column, score: Column, low: float = 0.5, high: float = 1.5) -> Column:
    """:func:`adjusted` by a score that has been read (null: none)."""
    new = base * multiplier(score, low, high)
    return F.when(new.isNull(), base).otherwise(F.least(new, F.lit(1.0)))


def score_zone(score: Column, low: float, verify: float, accept: float) -> Column:
    """accepted, needs_review or rejected by thresholds."""
    return F.when(score < low, "rejected").when(score >= accept, "accepted").when(score >= verify, "needs_review").otherwise("rejected")


def probability_zone(p: Column, low: float = 0.4, high: float = 0.6) -> Column:
    """At ``low`` exactly: review."""
    return F.when(p >= high, "accepted").when(p < low, "rejected").otherwise("needs_review")


def confident(p: Column, low: float = 0.4, high: float = 0.6) -> Column:
    """At ``low`` exactly: confident."""
    return (p <= low) | (p >= high)
