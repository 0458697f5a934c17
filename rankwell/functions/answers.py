"""What a language model answered, read as a score, a corrected query or a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, unless_refused

# Digits as words, and what a corrected query may begin with.
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
PREFIXES = ("corrected", "fixed", "edited", "correction", "grammar fixed")
#: The score where none can be read.
NEUTRAL = 5


def verified_score(answer: Column) -> Column:
    """0 to 9: a digit after "Score:", else the last digit that stands alone, else a word after "score:", else 5 (also for null)."""
    labelled = F.nullif(F.regexp_extract(answer, r"Score:\s*([0-9])\b", 1), F.lit("")).try_cast("int")
    alone = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"\b([0-9])\b"), F.lit(1)), F.lit(-1)).try_cast("int")
    word = F.lower(F.regexp_extract(answer, rf"(?i)Score:\s*({'|'.join(DIGITS)})\b", 1))
    named = F.nullif(F.array_position(F.array(*map(F.lit, DIGITS)), word), F.lit(0)) - 1
    return F.coalesce(labelled, alone, named.cast("int"), F.lit(NEUTRAL))


def corrected_query(query: Column, answer: Column) -> Column:
    """The answer without a label in front; the query itself where the answer is null, blank or refuses; a blank query stays empty."""
    out = F.coalesce(F.nullif(unless_refused(strip(answer)), F.lit("")), query)
    out = strip(F.regexp_replace(out, rf"(?i)^(?:{'|'.join(PREFIXES)})\s*[:\-]\s*", ""))
    blank = F.coalesce(strip(query), F.lit("")) == ""
    return F.when(blank, "").otherwise(F.coalesce(F.nullif(out, F.lit("")), query))


def on_topic(answer: Column) -> Column:
    """Whether the answer's first word is yes; an answer that is null or blank lets the query pass."""
    said = F.upper(strip(F.coalesce(answer, F.lit(""))))
    first = F.regexp_extract(F.regexp_replace(said, r"[.,!?]", ""), r"^\s*(\S*)", 1)
    return (said == "") | (first == "YES")
