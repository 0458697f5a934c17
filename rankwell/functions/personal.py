"""Personal information replaced by what it is, with terms that stay as they are.

All rules look at the text as it was. No span begins inside one of a rule before it (the end of
a phone number is no house number). One that runs into an earlier rule's span gives way where
they overlap, and what is left of it is masked, so that nothing personal stays because a protected
term stands next to it. The spans that remain are disjoint and are replaced from right to left.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that are never replaced.
PROTECTED = ("inside the u.s.", "in the u.s.", "within the u.s.", "U.S.A.", "U.S.", "USA", "United States", "non-citizens", "noncitizens", "citizens", "immigrants", "defendants", "plaintiffs", "persons", "a person")

_ADDRESS = r"\b\d{1,6}[ \t-]+[A-Za-z0-9.# \t-]{1,80}?,[ \t]*(?P<city>[A-Za-z .'-]{1,40}?),[ \t]*(?P<state>[A-Z]{2}\b|[A-Za-z .'-]{1,30})(?:[ \t]+\d{5}(?:-\d{4})?)?\b"
_PLACE = r"\b(?P<city>[A-Za-z .'-]{1,40}?),[ \t]*(?P<state>[A-Za-z .'-]{1,30})(?:[ \t]+\d{3}-\d{4}|[ \t]+\d{5}(?:-\d{4})?)?\b"
_STREET = r"\b\d{1,6}[ \t]+[A-Za-z0-9 .'#-]{1,60}?[ \t](?:street|st|avenue|ave|boulevard|blvd|road|rd|lane|ln|drive|dr|way|place|pl)\b"


def _city(match: re.Match) -> str:
    city, state = match["city"].strip(), match["state"].strip()
    return f"{state} {city}" if city and state else "a location"


def _labelled_place(match: re.Match) -> str:
    inner = ADDRESS.search(match["body"]) or PLACE.search(match["body"])
    return ": " + (_city(inner) if inner else "a location")


ADDRESS, PLACE = re.compile(_ADDRESS, re.I), re.compile(_PLACE, re.I)
_DIGITS = tuple("0123456789")
#: (what a text must hold one of for the rule to matter, pattern, replacement) in order of priority; a replacement of None keeps the span.
RULES = [
    (tuple(t.lower() for t in PROTECTED), re.compile("|".join(rf"(?<!\w){re.escape(t)}(?!\w)" for t in PROTECTED), re.I), None),
    (("name",), re.compile(r"(?<=\bname)[ \t]*[:-][ \t]*[^\n,]+", re.I), ": a person"),
    (("email", "e-mail"), re.compile(r"(?:(?<=\bemail)|(?<=\be-mail))[ \t]*[:-][ \t]*\S+", re.I), ": an email"),
    (("phone", "tel", "mobile"), re.compile(r"(?:(?<=\bphone)|(?<=\btel)|(?<=\btelephone)|(?<=\bmobile))[ \t]*[:-][ \t]*\+?[\d(][\d \t().-]*", re.I), ": a phone number"),
    (("addr",), re.compile(r"(?:(?<=\baddress)|(?<=\baddr))[ \t]*[:-][ \t]*(?P<body>[^\n]+)", re.I), _labelled_place),
    (("@",), re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), "an email"),
    (_DIGITS, re.compile(r"\+?\d[\d \t().-]{6,}\d"), "a phone number"),
    (_DIGITS, ADDRESS, _city),
    (_DIGITS, re.compile(_STREET, re.I), "a location"),
]
#: The rule for any "city, region" without a number before it; it takes much that is none, so it is asked for.
PLACES = ((",",), PLACE, _city)


def _outside(parts: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What of the parts lies before ``start`` or after ``end``."""
    return [p for a, b in parts for p in ((a, min(b, start)), (max(a, end), b)) if p[0] < p[1]]


def spans(text: str, places: bool = False) -> list[tuple[int, int, str | None]]:
    """Disjoint (start, end, replacement) in order, after priorities; parts after a span's first vanish."""
    taken: list[tuple[int, int]] = []
    out: list[tuple[int, int, str | None]] = []
    lowered = text.lower()
    for needs, pattern, by in [*RULES, PLACES] if places else RULES:
        new, at = [], 0
        if not any(x in lowered for x in needs):
            continue
        while match := pattern.search(text, at):
            inside = next((end for start, end in taken if start <= match.start() < end), None)
            at = inside or max(match.end(), match.start() + 1)
            if inside:
                continue
            parts = [match.span()]
            for start, end in taken:
                parts = _outside(parts, start, end)
            what = by(match) if callable(by) else by
            new += parts
            for a, b in parts:
                # blanks beside an earlier rule's span stay
                a += len(text[a:b]) - len(text[a:b].lstrip()) if a > match.start() else 0
                b -= len(text[a:b]) - len(text[a:b].rstrip()) if b < match.end() else 0
                if a < b and text[a:b].strip():
                    out.append((a, b, what))
                    what = what and ""
        taken += new
    return sorted(out)


def masked(text: str | None, places: bool = False) -> str | None:
    """The text with its personal information replaced; null stays null."""
    if text is None:
        return None
    for start, end, what in reversed(spans(text, places)):
        if what is not None:
            text = text[:start] + what + text[end:]
    return text


def masked_personal(text: Column, places: bool = False) -> Column:
    """:func:`masked` as a column; texts go to Python in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, places), na_action="ignore")

    return F.pandas_udf(run, "string")(text)
