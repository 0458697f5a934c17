"""Dictionary terms in queries, found in one pass over the query's words.

Terms and texts are cut into words and what stands between them, and a term is in a text if
its pieces stand there in a row; that is what a search between word boundaries finds. Numbers
in a term also match as words and the other way round: each such form is a further path
of the automaton. A dictionary beyond ``MOST_PATTERNS`` forms is joined on runs of pieces instead.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ordinals_fixed, to_roman
from .lexicon import ORDINALS, bare_amendments, ordinal

# Numbers as words, and which stand for which.
CARDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
PAIRS = [*((w, ordinal(k)) for k, w in enumerate(ORDINALS[:20], 1)), *((w, str(k)) for k, w in enumerate(CARDINALS, 1)), *((f"twenty {w}", str(20 + k)) for k, w in enumerate(CARDINALS[:6], 1))]

#: Forms of terms that an automaton is made of; it is broadcast, so their number is checked.
MOST_PATTERNS = 100_000
_WORD = r"\p{L}\p{N}_"
PIECES = rf"[{_WORD}]+|[^{_WORD}]+"


def pieces(text: Column) -> Column:
    """Words and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


#: Joins pieces where they are compared as one string.
_BAR = "\x01"


def _barred(cut: Column) -> Column:
    return F.concat(F.lit(_BAR), F.array_join(cut, _BAR), F.lit(_BAR))


def patterns(terms: DataFrame) -> DataFrame:
    """term, pattern: each term in lower case, and its forms with one number as a word or one word as a number, everywhere in it.

    A pattern is its pieces between bars.
    """
    known = terms.select("term").where(F.col("term") != "").distinct().withColumn("own", _barred(pieces(F.lower("term"))))
    bar = lambda text: _BAR + text.replace(" ", f"{_BAR} {_BAR}") + _BAR
    pairs = F.explode(F.array(*(F.struct(F.lit(bar(w)).alias("word"), F.lit(bar(n)).alias("number")) for w, n in PAIRS))).alias("pair")
    word, number = F.col("pair.word"), F.col("pair.number")
    form = F.when(F.contains("own", number), F.replace("own", number, word)).when(F.contains("own", word), F.replace("own", word, number))
    forms = known.select("term", "own", pairs).select("term", form.alias("pattern")).where("pattern IS NOT NULL")
    return known.select("term", F.col("own").alias("pattern")).unionByName(forms).distinct()


class Automaton:
    """All patterns (sequences of pieces) that end at each place of a text, by goto, failure and output links."""

    def __init__(self, entries: list[tuple[list[str], int]]):
        self.next: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]
        for sequence, what in entries:
            at = 0
            for piece in sequence:
                if piece not in self.next[at]:
                    self.next[at][piece] = len(self.next)
                    self.next.append({})
                    self.own.append([])
                at = self.next[at][piece]
            self.own[at].append(what)
        self.fail = [0] * len(self.next)
        self.up = [0] * len(self.next)  # the nearest suffix that is a pattern
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for piece, to in self.next[at].items():
                back = self.fail[at]
                while back and piece not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(piece, 0)
                waiting.append(to)
            back = self.fail[at]
            self.up[at] = back if self.own[back] else self.up[back]

    def found(self, text: list[str]) -> dict[int, int]:
        """What is in the text, with the place where it first ends."""
        out: dict[int, int] = {}
        at = 0
        for i, piece in enumerate(text):
            while at and piece not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(piece, 0)
            hit = at
            while hit:
                for what in self.own[hit]:
                    out.setdefault(what, i)
                hit = self.up[hit]
        return out


def term_matches(queries: DataFrame, terms: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """query_id, term for each term (column term) that stands in the query's text (query_id, text), in any of its forms.

    Case doesn't matter, and wrong endings of ordinals in the text are corrected first. Null and empty texts and terms match nothing.
    """
    spark = queries.sparkSession
    known = patterns(terms)
    texts = queries.select("query_id", pieces(F.lower(ordinals_fixed(F.coalesce("text", F.lit(""))))).alias("pieces"))
    held = known.limit(most + 1).collect()
    schema = T.StructType([queries.schema["query_id"], T.StructField("term", T.StringType())])
    if len(held) > most:
        return _joined(texts, known)
    shared = spark.sparkContext.broadcast([(r["term"], r["pattern"].strip(_BAR).split(_BAR)) for r in held])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        automaton = Automaton([(p, i) for i, (_, p) in enumerate(entries)])
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = dict.fromkeys(entries[what][0] for what in automaton.found(text))
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], schema.names)

    return texts.mapInArrow(scan, schema)


def _joined(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a join: runs of pieces of the text, as long as some pattern is, on the pattern."""
    sized = known.select("term", "pattern", (F.size(F.split("pattern", _BAR)) - 2).alias("n"))
    sizes = F.broadcast(sized.select("n").distinct())  # as many rows as patterns have lengths
    starts = texts.select("query_id", "pieces").join(sizes, F.size("pieces") >= F.col("n"))
    runs = starts.select("query_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("pieces") - F.col("n") + 1), lambda i: _barred(F.slice("pieces", i, F.col("n"))))).alias("pattern")).distinct()
    return runs.join(sized.select("term", "pattern"), "pattern").select("query_id", "term").distinct()


def cited_sections(queries: DataFrame, articles: DataFrame) -> DataFrame:
    """query_id, article, section, nth for the sections that a query names of the first article in it.

    articles: article, section (the labels there are, like "Article II" and "Section 8"). The article may be a
    number, a Roman numeral or an ordinal word and must be in the dictionary; a section must be one of the
    article's, unless none of these is known. Sections keep their order (``nth``), repeated ones once.
    """
    # one column after the other: what is used several times is computed once
    rows = queries.select("query_id", F.lower(ordinals_fixed(F.coalesce("text", F.lit("")))).alias("t"))
    token = F.regexp_extract("t", r"\barticle\s+([ivxlcdm]+|[0-9]+|" + "|".join(ORDINALS[:20]) + r")\b", 1)
    # a bare sign counts only after a word, where a word boundary is
    cited = F.regexp_extract_all("t", F.lit(r"\b(?:section|§)\s*([0-9]+)\b"), F.lit(1))
    rows = rows.select("query_id", token.alias("token"), F.array_distinct(F.transform(cited, lambda s: s.cast("decimal(38,0)").cast("string"))).alias("sections")).where((F.col("token") != "") & (F.size("sections") > 0))
    spelled = F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS[:20])), F.col("token")), F.lit(0))
    rows = rows.withColumn("number", F.coalesce(F.col("token").try_cast("int"), spelled.cast("int")))
    roman = F.get(F.array(*(F.lit(to_roman(k).lower()) for k in range(1, 101))), F.col("number") - 1)
    labels = F.when(F.col("number").isNull(), F.array("token")).otherwise(F.array_compact(F.array(roman, F.col("number").cast("string"))))
    asked = rows.select("query_id", "sections", F.posexplode(labels).alias("choice", "label")).withColumn("label", F.concat(F.lit("article "), "label"))
    known = articles.where(F.trim("article") != "").groupBy(F.lower(F.trim("article")).alias("label")).agg(F.min(F.trim("article")).alias("article"), F.collect_set(F.lower(F.trim("section"))).alias("valid"))
    w = Window.partitionBy("query_id").orderBy("choice")
    first = asked.join(known, "label").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    valid = F.filter("valid", lambda s: s != "")
    rows = first.select("query_id", "article", valid.alias("valid"), F.posexplode("sections").alias("nth", "n")).withColumn("section", F.concat(F.lit("Section "), F.col("n")))
    return rows.where((F.size("valid") == 0) | F.array_contains("valid", F.lower("section"))).select("query_id", "article", "section", "nth")


def find_textual(queries: DataFrame, titles: DataFrame, articles: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """query_id, term, kind: every label that a query names, once, by the first way it was found.

    titles: title. articles: article, section. kind is guess (a bare number or ordinal taken for an amendment), term (a
    title or article in the text; the bare word "Amendment" is none) or section (article, section, and both together).
    """
    names = titles.select(F.trim("title").alias("term")).unionByName(articles.select(F.trim("article").alias("term")).where("term <> 'Amendment'"))
    fixed = queries.select("query_id", ordinals_fixed(F.col("text")).alias("text"))
    guess = bare_amendments(fixed, titles, "text").where("title IS NOT NULL").select("query_id", F.col("title").alias("term"), F.lit(0).alias("way"))
    match = term_matches(queries, names, most).select("query_id", "term", F.lit(1).alias("way"))
    cited = cited_sections(queries, articles)
    each = F.explode(F.array("article", "section", F.concat_ws(" ", "article", "section"))).alias("term")
    cited = cited.select("query_id", each, F.lit(2).alias("way"))
    best = guess.unionByName(match).unionByName(cited).groupBy("query_id", "term").agg(F.min("way").alias("way"))
    return best.select("query_id", "term", F.element_at(F.array(*map(F.lit, ("guess", "term", "section"))), F.col("way") + 1).alias("kind"))
