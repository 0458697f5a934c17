"""Dictionary and alias matching for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised, ordinals_fixed, to_roman, tokens, without_stop_words

# Ordinal words, and the stop words that queries lose.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second", "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def ordinal(n: int) -> str:
    ending = "th" if 11 <= n % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{ending}"


def amendment_title(text: Column) -> Column:
    """"fifth amendment § 2" -> "5th Amendment Section 2"; null if there is no amendment in it."""
    t = ordinals_fixed(normalised(text))
    for k in range(len(ORDINALS), 0, -1):
        t = F.regexp_replace(t, rf"\b{ORDINALS[k - 1]}\b", ordinal(k))
    number = F.nullif(F.regexp_extract(t, r"\b([0-9]+(?:st|nd|rd|th))\s+amendment\b", 1), F.lit(""))
    section = F.nullif(F.regexp_extract(t, r"(?:section|§)\s*([0-9]+)", 1), F.lit(""))
    return F.concat(number, F.lit(" Amendment"), F.coalesce(F.concat(F.lit(" Section "), section), F.lit("")))


# Numbers as words that may stand alone for an amendment, besides the first 26 ordinals.
CARDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def bare_amendments(df: DataFrame, titles: DataFrame, text: str) -> DataFrame:
    """``df`` with the column title: "the 5th", "fifth" or "5" alone as the dictionary's "5th Amendment"; else null.

    ``titles`` has the column title. Null texts and texts that speak of an amendment or an article have none.
    """
    words = [F.array(*map(F.lit, x)) for x in (CARDINALS, ORDINALS[:26], [o.replace("-", " ") for o in ORDINALS[:26]])]
    # one column after the other: what is used several times is computed once
    out = df.withColumn("_t", F.lower(F.trim(F.col(text)))).withColumn("_alone", F.regexp_replace("_t", r"^the\s+", ""))
    digits = F.nullif(F.regexp_extract("_alone", r"^([0-9]+)(?:st|nd|rd|th)?$", 1), F.lit("")).try_cast("int")
    out = out.withColumn("_number", F.coalesce(digits, *(F.nullif(F.array_position(x, F.col("_alone")), F.lit(0)).cast("int") for x in words)))
    number, last = F.col("_number"), F.col("_number") % 10
    ending = F.when((number % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    wanted = F.when(~F.col("_t").rlike(r"\b(?:amendment|article)\b") & (number > 0), F.concat(number, ending, F.lit(" amendment")))
    known = titles.groupBy(F.lower("title").alias("_wanted")).agg(F.min("title").alias("title"))
    # behind a generator no filter on the title is pushed down and spelled out again below
    return out.withColumn("_wanted", F.explode(F.array(wanted))).join(known, "_wanted", "left").drop("_wanted", "_t", "_alone", "_number")


def article_and_section(text: Column) -> Column:
    """struct(article: "Article II" or null, section: int or null)."""
    t = normalised(text)
    found = F.nullif(F.regexp_extract(t, r"\barticle\s+([0-9]+|[ivx]+)\b", 1), F.lit(""))
    number = F.get(F.array(*(F.lit(to_roman(k)) for k in range(1, 51))), found.try_cast("int") - 1)
    article = F.concat(F.lit("Article "), F.coalesce(number, F.upper(found)))
    section = F.nullif(F.regexp_extract(t, r"\bsection\s+([0-9]+)\b", 1), F.lit("")).try_cast("int")
    return F.struct(article.alias("article"), section.alias("section"))


def cleaned_query(text: Column, domain_pattern: str | None = None) -> Column:
    """Lower case, ordinals corrected, the domain's own words and stop words gone."""
    t = ordinals_fixed(F.lower(text))
    if domain_pattern:
        t = F.regexp_replace(t, domain_pattern, " ")
    return F.array_join(without_stop_words(tokens(t), list(STOP_WORDS)), " ")


def dictionary(df: DataFrame, article: str, section: str) -> DataFrame:
    """Each article with its sorted set of sections."""
    return df.groupBy(article).agg(F.array_sort(F.collect_set(section)).alias("sections"))


def word_matches(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term for every dictionary term whose words appear in a row in the query.

    Word runs of the query of up to the longest term's length are joined on the term, an
    equi-join where a regular expression per pair would compare all with all.
    """
    t = terms.select("term", F.array_join(tokens(F.col("term")), " ").alias("run"), F.size(tokens(F.col("term"))).alias("n")).where("n > 0")
    longest = t.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    words = queries.select("query_id", tokens(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda k: F.array_join(F.slice(F.col("w"), i + 1, k), " "))))
    spread = words.where(F.size("w") > 0).select("query_id", F.explode(F.array_distinct(runs)).alias("run"))
    return spread.join(t, "run").select("query_id", "term").distinct()


def match_kind(text: Column, keyword: Column) -> Column:
    """2 equal, 1 one inside the other or a shared word, 0 otherwise."""
    a, b = normalised(text), normalised(keyword)
    part = F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(tokens(a), tokens(b))
    return F.when((a == "") | (b == ""), 0).when(a == b, 2).when(part, 1).otherwise(0)


def unique_aliases(df: DataFrame, title: str, alias: str) -> DataFrame:
    """Distinct (title, alias) without case; an alias that is its title goes."""
    a, t = F.lower(F.trim(F.col(alias))), F.lower(F.trim(F.col(title)))
    return df.where(a != t).select(t.alias("title"), a.alias("alias")).distinct()
