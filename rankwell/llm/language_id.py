"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built and laid out as a dense
transition table, or as a sorted list of its edges if the samples hold more letters
than SYMBOLS has room for. A text is parsed greedily into the longest phrases
that occur in the labelled text; the fewer phrases, the more alike. Phrases times
log2 of the labelled length, divided by the characters, estimates the cross-entropy,
and the language with the least wins.

The labelled text is a bounded sample: at most ``SAMPLE_DOCS`` documents and
``SAMPLE_CHARS`` characters per language, chosen by a hash of the id. Of longer texts
windows are taken that are spread evenly over the whole of them. Prediction reads
every character of every text. Texts are parsed in lanes of ``LANE`` characters, and a
phrase ends where a lane ends, so long texts take many lanes instead of many steps.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back

SAMPLE_DOCS = 64
SAMPLE_CHARS = 16_384
#: Symbols of dense tables: 0 stands for all that is no letter, 1 for letters in no sample.
SYMBOLS = 64
#: Characters of a window of a sampled text.
WINDOW = 256
LANE = 2048
#: Characters that are parsed at a time.
BATCH_CHARS = 2 << 20
UNDETERMINED = "und"
_NEW_PHRASE = 1 << 30


class SuffixAutomaton:
    """All substrings of a symbol sequence; built online, one symbol at a time."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] != self.length[p] + 1:
                copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = self.link[cur] = copy
            else:
                self.link[cur] = q
        return cur

    def table(self) -> np.ndarray:
        """states x SYMBOLS: the state after a symbol; a phrase that cannot go on starts anew."""
        root = np.zeros(SYMBOLS, np.int32)
        for c, s in self.next[0].items():
            root[c] = s
        out = np.tile(root | _NEW_PHRASE, (len(self.next), 1))
        for s, edges in enumerate(self.next):
            for c, t in edges.items():
                out[s, c] = t
        return out


def _is_letter(code: int) -> bool:
    return unicodedata.category(chr(code))[0] == "L"


class CrossParser:
    """Tables for some languages, and the parse of texts under all of them at once."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(x for x in samples if any(c.isalpha() for c in samples[x]))
        seen: dict[str, int] = {}
        for x in self.languages:
            for c in samples[x].lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        listed = sorted(seen, key=lambda c: (-seen[c], c))
        self.codes = codes = {c: k + 2 for k, c in enumerate(listed)}
        self.dense = len(listed) + 2 <= SYMBOLS
        self.symbols = SYMBOLS if self.dense else len(listed) + 2
        self.letter = np.array([_is_letter(k) for k in range(0x10000)])
        self.symbol = np.zeros(0x10000, np.uint8 if self.dense else np.int32)
        for k in np.flatnonzero(self.letter):
            self.symbol[k] = codes.get(chr(k).lower(), 1)
        tables, keys, values, roots, self.starts, at = [], [], [], [], [], 0
        for x in self.languages:
            one = SuffixAutomaton(self._lettered(_points(samples[x]))[1].tolist())
            if self.dense:
                tables.append(one.table())
                tables[-1] += at  # the states of all languages are far fewer than _NEW_PHRASE
            else:
                edges = sorted(((s + at) * self.symbols + c, t + at) for s, out in enumerate(one.next) for c, t in out.items())
                keys += [k for k, _ in edges]
                values += [t for _, t in edges]
                root = np.full(self.symbols, at, np.int64)
                for c, t in one.next[0].items():
                    root[c] = t + at
                roots.append(root | _NEW_PHRASE)
            self.starts.append(at)
            at += len(one.next)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        self.keys, self.values, self.roots = np.array(keys, np.int64), np.array(values, np.int64), np.array(roots)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])

    def _lettered(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code point is a letter, and its symbol."""
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            near = points.copy()
            near[far] = 0
        else:
            near = points
        letters, symbols = self.letter[near], self.symbol[near]
        for k in far:
            letters[k] = _is_letter(int(points[k]))
            symbols[k] = self.codes.get(chr(points[k]).lower(), 1) if letters[k] else 0
        return letters, symbols

    def _after(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states (languages x lanes) after a symbol of each lane, marked where a phrase starts anew."""
        wanted = state * self.symbols + symbols
        if self.dense:
            return self.table.take(wanted)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], self.roots[:, symbols])

    def _phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each lane (descending sizes, none empty) in each language."""
        state = np.repeat(np.array(self.starts, np.int64)[:, None], len(sizes), 1)
        phrases = np.ones((len(self.starts), len(sizes)), np.int32)
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for t, n in enumerate(live.tolist()):
            entry = self._after(state[:, :n], symbols[starts[:n] + t])
            phrases[:, :n] += entry >> 30
            state[:, :n] = entry & (_NEW_PHRASE - 1)
        return phrases

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether there is any letter, for each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        letters, symbols = self._lettered(_points("".join(texts)))
        ends = np.cumsum(sizes)
        sums = np.zeros(len(letters) + 1, np.int32 if len(letters) < 1 << 31 else np.int64)
        np.cumsum(letters, out=sums[1:])
        lettered = sums[ends] > sums[ends - sizes]
        total = np.zeros((len(self.languages), len(texts)))
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        if len(owner) and self.languages:
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            begin = (ends - sizes)[owner] + nth * LANE
            size = np.minimum(LANE, ends[owner] - begin)
            order = np.argsort(-size, kind="stable")
            phrases = self._phrases(symbols, begin[order], size[order])
            for k, row in enumerate(phrases):
                total[k] = np.bincount(owner[order], row, len(texts))
        cost = total * self.bits[:, None] / np.maximum(sizes, 1) if self.languages else total
        names, scores = [], []
        for i, known in enumerate(lettered.tolist()):
            if not known or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best, *others = np.argsort(cost[:, i], kind="stable").tolist()
            names.append(self.languages[best])
            scores.append(1 - float(cost[best, i] / cost[others[0], i]) if others else 1.0)
        return names, scores, lettered.tolist()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def spread(text: str, most: int) -> str:
    """At most ``most`` characters of a text: the whole of it, or windows spread evenly over it."""
    if len(text) <= most:
        return text
    n = max(1, most // WINDOW)
    size = max(0, most - n + 1) // n
    step = (len(text) - size) / max(1, n - 1)
    return " ".join(text[int(k * step) : int(k * step) + size] for k in range(n))


def _spread(text: Column, most: int) -> Column:
    """The same as :func:`spread` in a plan, so that no more than ``most`` characters of a text leave it."""
    n = max(1, most // WINDOW)
    size = max(0, most - n + 1) // n
    step = (F.length(text) - size) / max(1, n - 1)
    windows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, F.floor(k * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(windows, " "))


def labelled_samples(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS) -> dict[str, str]:
    """For each language some of its text: the bounded sample a parser is built from."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    mixed = F.xxhash64("id")
    picked = rows.groupBy("lang", F.pmod(mixed, F.lit(docs_each)).alias("bucket")).agg(F.min(F.struct(mixed.alias("h"), "id")).alias("least"))
    ids = [r[0] for r in picked.select("least.id").distinct().collect()]
    if not ids:
        return {}
    texts: dict[str, list[tuple]] = {}
    for r in rows.where(F.col("id").isin(ids)).select("lang", "id", _spread(F.col("text"), chars_each).alias("text")).groupBy("lang", "id").agg(F.min("text").alias("text")).collect():
        texts.setdefault(r["lang"], []).append((str(r["id"]), r["text"]))
    out = {}
    for lang, found in texts.items():
        left, parts = chars_each, []
        found.sort(key=lambda x: (len(x[1]), x))
        for k, (_, text) in enumerate(found):
            parts.append(spread(text, -(-left // (len(found) - k))))
            left -= len(parts[-1])
        out[lang] = " ".join(x for x in parts if x)
    return out


def identify_languages(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) as struct ``row`` with lang_pred, score (0 to 1) and lettered.

    Learns from rows with non-null id, text and language where ``learn_from`` holds.
    Null texts and texts without a letter are ``und`` with score 0, as is every text
    if there is nothing to learn from. The score is 1 minus the ratio of the winner's
    normalised phrases to the runner-up's; ties go to the first name in order, with
    score 0. With one language learned the score is 1.
    """
    spark = docs.sparkSession
    samples = labelled_samples(docs if learn_from is None else docs.where(learn_from), id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(samples)  # at most SAMPLE_CHARS characters a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in batches:
            parser = parser or CrossParser(shared.value)
            texts = [x or "" for x in (pc.struct_field(batch.column(0), [inside]) if inside >= 0 else batch.column(1)).to_pylist()]
            names, scores, lettered = [], [], []
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < BATCH_CHARS:
                    held += len(texts[to])
                    to += 1
                for whole, part in zip((names, scores, lettered), parser(texts[at:to]), strict=True):
                    whole += part
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())], ["row", "lang_pred", "score", "lettered"])

    # a text that its row carries is sent with the row only
    names = carry or docs.columns
    inside = names.index(text_col) if text_col in names else -1
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), *([F.col(text_col).alias("text")] if inside < 0 else []))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lettered", T.BooleanType())])
    return rows.mapInArrow(giving_back(predict), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in some language; null texts and texts without a letter go."""
    return identify_languages(docs).where("lettered").select("row.*")
