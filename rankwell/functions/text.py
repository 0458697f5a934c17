"""Text functions as column expressions.

Words are runs of Unicode letters, digits and underscores; Python's strip and split
take all white space, so patterns are used where Spark's trim takes only spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_text(*fields: Column) -> Column:
    """The first field with more than white space, stripped; else empty."""
    return F.coalesce(*(blank_to_null(f) for f in fields), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that are in the document."""
    n = F.size(F.array_distinct(query))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, doc)) / n)


def bm25(query: Column, doc: Column, k1: float = 1.5, b: float = 0.75, average: float = 2000.0) -> Column:
    """Term-frequency relevance summed over query tokens, repeated ones repeatedly; no inverse document frequency."""
    length = k1 * (1 - b + b * F.size(doc) / average)

    def term(total: Column, token: Column) -> Column:
        tf = F.size(F.filter(doc, lambda d: d == token)).cast("double")
        return total + tf * (k1 + 1) / (tf + length)

    return F.when((F.size(query) == 0) | (F.size(doc) == 0), F.lit(0.0)).otherwise(F.aggregate(query, F.lit(0.0), term))


def normalised(text: Column) -> Column:
    """Stripped, lower-cased, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def ordinals_fixed(text: Column) -> Column:
    """Corrects the endings of ordinal numbers: 1th -> 1st, 22th -> 22nd, but 11th to 13th stay."""
    out = F.regexp_replace(text, r"(?i)\b(\d*1[123])(?:st|nd|rd|th)\b", "$1th")
    for digit, ending in (("1", "st"), ("2", "nd"), ("3", "rd")):
        out = F.regexp_replace(out, rf"(?i)\b((?:\d*[02-9])?{digit})th\b", f"$1{ending}")
    return F.regexp_replace(out, r"(?i)\b(\d*[04-9])(?:st|nd|rd)\b", "$1th")


def roman(n: Column, most: int = 50) -> Column:
    """Roman numeral of 1 to ``most``, else null."""
    return F.get(F.array(*(F.lit(to_roman(k)) for k in range(1, most + 1))), n - 1)


def to_roman(n: int) -> str:
    out = ""
    for value, numeral in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += numeral * (n // value)
        n %= value
    return out


def without_stop_words(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, stop)), w))


def truncated(text: Column, words: int) -> Column:
    """At most so many white-space-separated words."""
    return F.array_join(F.slice(F.split(strip(text), r"\s+"), 1, words), " ")


# What an answer that refuses begins or says.
REFUSALS = (
    r"\bi(?:'m| am) sorry\b", r"\bi can(?:no|')t (?:assist|help)\b", r"\bas an ai\b", r"\bunable to (?:assist|help|comply)\b", r"\bcannot provide\b",
    r"\bsorry[, ]+i\s+can(?:not|'t)\s+help\s+you", r"\bi\s+can(?:not|'t)\s+assist\s+with\s+that\s+request", r"\bi\s+am\s+unable\s+to\s+help\s+with\s+that",
    r"\bi\s+am\s+not\s+able\s+to\s+do\s+that", r"\bi\s+cannot\s+fulfill\s+that\s+request", r"\bnot\s+able\s+to\s+provide\s+that\s+information",
    r"\bviolates\s+content\s+policy", r"\bi'm\s+sorry[, ]*\s+but\s+i\s+cannot",
)


def unless_refused(text: Column) -> Column:
    """Null where the text refuses."""
    return F.when(F.lower(text).rlike("|".join(REFUSALS)), None).otherwise(text)


def clean_summary(text: Column) -> Column:
    """Without code fences, backticks and a leading "Summary:"."""
    out = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    out = F.regexp_replace(out, "`", "")
    return strip(F.regexp_replace(strip(out), r"(?i)^summary\s*:\s*", ""))


def scrub_personal(text: Column, addresses: bool = False) -> Column:
    """E-mail addresses, phone numbers, social security numbers and labelled fields go; optionally street addresses too."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")
    out = F.regexp_replace(out, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "")
    out = F.regexp_replace(out, r"(?:\+?[0-9]{1,2}[ .-])?\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", "")
    out = F.regexp_replace(out, r"(?i)\b(?:name|dob|ssn|passport|a-number)\s*:\s*[^\s,;]+", "")
    if addresses:
        out = F.regexp_replace(out, r"(?i)\b[0-9]+ (?:[A-Za-z]+ ){1,3}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr)\b\.?", "")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def clean_text(text: Column) -> Column:
    """Tags, emoji and typographic quotes go or become plain; white space collapses."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")
    out = F.translate(out, "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


def clause_numbers(text: Column) -> Column:
    """(a) -> (1), (b) -> (2), ... for single lower-case letters."""
    out = text
    for k in range(26):
        out = F.replace(out, F.lit(f"({chr(97 + k)})"), F.lit(f"({k + 1})"))
    return out


def first_number(text: Column) -> Column:
    """The first run of digits as a number, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def citation_prefix(title: Column, chapter: Column, section: Column) -> Column:
    """Title n Chapter c Section s, leaving out what is missing."""
    part = lambda name, c: F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{name} "), c))
    return F.concat_ws(" ", part("Title", title), part("Chapter", chapter), part("Section", section))


def without_citation(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^(?:Title \S+ ?)?(?:Chapter \S+ ?)?(?:Section \S+ ?)?", ""))


def regulation_references(text: Column) -> Column:
    """Sorted distinct "t CFR p.s" citations, without paragraph letters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+ CFR [0-9]+\.[0-9]+)"), F.lit(1))))


def cited_regulations(text: Column) -> Column:
    """Sorted distinct citations, "t CFR p.s" or "CFR p.s" without a title; one without is left out where its section has one with. Of several titles of a section the last counts."""
    own = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([0-9]+\s+CFR\s+\w+\.[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda c: F.struct(F.regexp_extract(c, r"(\S+)$", 1).alias("section"), F.regexp_extract(c, r"^([0-9]+)", 1).alias("title")))
    last = F.filter(own, lambda c, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda d: d["section"] == c["section"]))
    bare = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)CFR\s+(\w+\.[0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    alone = F.array_except(bare, F.transform(last, lambda c: c["section"]))
    return F.array_sort(F.concat(F.transform(last, lambda c: F.concat(c["title"], F.lit(" CFR "), c["section"])), F.transform(alone, lambda s: F.concat(F.lit("CFR "), s))))


def clause_number(text: Column) -> Column:
    """"(a)", "A" or "1" as "(1)"; section signs go, letters count from 1, numbers with letters stay in lower case, and the rest is "main"."""
    t = strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"§+\s*", ""))
    t = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(t, r"^\(+", "("), r"\)+$", ")"), r"(?i)^\(?([a-z0-9]+)\)?$", 1))
    letter = F.ascii(t) - 96
    return F.when(t == "", "main").when(t.rlike("^[a-z]$"), F.concat(F.lit("("), letter.cast("string"), F.lit(")"))).when(t.rlike("^[a-z]+$"), "main").otherwise(F.concat(F.lit("("), t, F.lit(")")))


def page_date(iso: Column) -> Column:
    return F.concat(F.lit("Last Updated:"), F.date_format(F.try_to_timestamp(iso), "MM/dd/yyyy"))


def split_clauses(text: Column, most: int = 5000) -> Column:
    """Greedy packing of paragraphs into clauses of at most ``most`` characters; longer paragraphs split at sentence ends.

    An ordered fold over the pieces with the finished clauses and the one being filled.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.split(p, r"(?<=[.!?])\s+"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit("\n\n"), piece))
        fits = F.length(joined) <= most
        closed = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(closed.alias("done"), F.when(fits, joined).otherwise(piece).alias("open"))

    return F.aggregate(pieces, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def repaired_clauses(clauses: Column, navigation: str = r"(?i)^\s*(?:home|next|previous|back to top|skip to content|search|menu)\s*$", most: int = 10_000) -> Column:
    """Clauses (structs with ``text``) without those that are blank or mere navigation, longer texts cut at ``most`` characters."""
    kept = F.filter(clauses, lambda c: (F.coalesce(strip(c["text"]), F.lit("")) != "") & ~c["text"].rlike(navigation))
    return F.transform(kept, lambda c: c.withField("text", F.substring(c["text"], 1, most)))


def entities_resolved(text: Column) -> Column:
    """Common entities and typographic signs as plain characters, letters in parentheses as numbers."""
    out = text
    for entity, char in (("&nbsp;", " "), ("&sect;", "§"), ("&mdash;", "-"), ("&ndash;", "-"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clause_numbers(clean_text(out))
