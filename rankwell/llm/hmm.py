"""Hidden Markov language model.

Words are lower-cased (A-Z) runs of bytes that are no ASCII white space; every text
ends with an end token. A state emits a *word class*: each frequent word is a class of
its own and the other words fall into a fixed number of classes by checksum. Within a
class, words have add-one probabilities from the counts of the whole training corpus,
with one share for unknown words. So the states' tables are bounded while every word
of the corpus counts.

Baum-Welch runs over all training texts: each partition adds up expected counts as
fixed-point integers, which are summed in any order to the same result, and the driver
(which holds one bounded table) re-estimates. Scoring runs the scaled forward recursion
over each whole text, which gives the exact likelihood.

Texts of over RUN tokens are taken apart into runs that are worked on side by side: the
recursion over a run is a product of matrices, so products of whole runs, chained from
the front and from the back, give the exact forward and backward state at each run's
ends. Nothing is cut, and memory is bounded however long a text is.

Counts of rare words never reach the driver or a broadcast: they are joined to the
texts' rare words. Only words with at least 1/HEAVY of the tokens are broadcast, so
there are at most HEAVY of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Words with at least 1/HEAVY of the training tokens are broadcast with their counts.
HEAVY = 1 << 18
#: Words with at least 1/OWN of the training tokens are classes of their own.
OWN = 1 << 14
#: Classes that the other words share.
SHARED = 512
STATES = 6
ROUNDS = 8
#: Tokens of a text that are worked on in a row; its runs are worked on side by side.
RUN = 1024
#: Tokens whose states are held at a time. Bounds memory only.
BATCH_TOKENS = 1 << 20
#: Steps after which a product of matrices is scaled.
SCALED = 8
#: Distinct words a counting task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Expected counts are summed as multiples of 1/FIXED.
FIXED = 1 << 20
#: White space cannot be in a word, so this stands for the end of a text.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, with the end token."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def shared_class(word: bytes) -> int:
    return zlib.crc32(word) % SHARED


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """word, n over all texts; counted within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    found = texts.select(text_col).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """Broadcast part of the vocabulary: bounded by HEAVY words and SHARED classes."""

    heavy: dict[bytes, tuple[int, int]]  # word -> (count, class)
    own: int
    tokens: int  # N
    types: int  # V
    shared_tokens: np.ndarray  # by shared class: tokens and distinct words
    shared_types: np.ndarray
    own_tokens: np.ndarray

    @property
    def size(self) -> int:
        return self.own + SHARED

    def class_of(self, word: bytes) -> int:
        found = self.heavy.get(word)
        return found[1] if found else self.own + shared_class(word)

    def class_tokens(self) -> np.ndarray:
        return np.concatenate([self.own_tokens, self.shared_tokens]).astype(float)

    def log_shares(self) -> np.ndarray:
        """log10 of each class's add-one denominator; 0 for a word that is its class."""
        return np.concatenate([np.zeros(self.own), np.log10(self.shared_tokens + self.shared_types + 1)])


def learn_classes(counts: DataFrame) -> Classes:
    """From the stored table of all word counts, what is bounded."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = sorted(((r["word"].encode(), r["c"]) for r in counts.where(F.col("c") * HEAVY >= n).collect()), key=lambda x: (-x[1], x[0]))
    own = [x for x in heavy if x[1] * OWN >= n]
    known = {w: (c, k) for k, (w, c) in enumerate(own)}
    known |= {w: (c, len(own) + shared_class(w)) for w, c in heavy[len(own) :]}
    at = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(SHARED)).cast("int").alias("at")
    tokens, types = np.zeros(SHARED), np.zeros(SHARED)
    for r in counts.where(F.col("c") * OWN < n).groupBy(at).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["at"]], types[r["at"]] = r["c"], r["v"]
    return Classes(known, len(own), n, v, tokens, types, np.array([c for _, c in own], float))


ENCODED = "trains boolean, classes binary, n_tokens long, n_known long, heavy_log double, class_log double, share_log double, rare array<string>, times array<int>"


def encoded(docs: DataFrame, classes: Classes, text_col: str) -> DataFrame:
    """Each text (columns id, trains, text) as its class sequence, with sums over its heavy words and its rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        shares = c.log_shares()
        place = {w: k for k, w in enumerate(c.heavy)}.get
        class_of = np.array([k for _, k in c.heavy.values()], np.uint16)
        log_of = np.log10(np.array([n for n, _ in c.heavy.values()], float) + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in range(8)]
                for text in batch.column(2):
                    words = words_of(text.as_py())
                    found = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                    ids = np.empty(len(words), np.uint16)
                    known = found >= 0
                    ids[known] = class_of[found[known]]
                    others = [words[k] for k in np.flatnonzero(~known).tolist()]
                    ids[~known] = [c.own + shared_class(w) for w in others]
                    logs = log_of[found[known]]
                    rare = Counter(others)
                    row = (ids.tobytes(), len(words), len(words) - len(others), float(logs.sum()), float(logs[ids[known] >= c.own].sum()), float(shares[ids].sum()), [w.decode() for w in rare], list(rare.values()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
                arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["id", "trains", "classes", "n_tokens", "n_known", "heavy_log", "class_log", "share_log", "rare", "times"])

    id_field = T.StructField("id", docs.schema["id"].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL(ENCODED).fields])
    return docs.select("id", "trains", F.col(text_col)).mapInArrow(encode, schema)


@dataclass
class Model:
    """Start, transition and class emission probabilities of the states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @staticmethod
    def initial(classes: Classes, states: int, seed: int = 7) -> Model:
        rng = np.random.RandomState(seed)
        prior = classes.class_tokens() + 1
        emit = prior[:, None] * rng.uniform(0.25, 1.75, (len(prior), states))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    @staticmethod
    def estimated(expected: dict[int, list[int]], classes: Classes, states: int) -> Model:
        """From summed fixed-point counts; a little of the unigram keeps every class possible."""
        prior = classes.class_tokens() + 1
        emit = np.outer(prior / prior.sum(), np.full(states, 50.0))
        move, start = np.full((states, states), 1.0), np.ones(states)
        for k, row in expected.items():
            into = emit[k] if k >= 0 else start if k == -1 else move[-2 - k]
            into += np.array(row, float) / FIXED
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Runs:
    """Texts taken apart into runs of at most RUN tokens: sizes and starts of runs, and the first and last run of each text."""

    size: np.ndarray
    start: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray) -> Runs:
        n = -(-sizes // RUN)
        last = np.cumsum(n) - 1
        size = np.full(n.sum(), RUN, np.int64)
        size[last] = sizes - (n - 1) * RUN
        return Runs(size, np.cumsum(size) - size, last - n + 1, last)

    def lanes(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``some`` runs, longest first, as many at a time as BATCH_TOKENS hold; and how many are live at each step."""
        order = some[np.argsort(-self.size[some], kind="stable")]
        at = 0
        while at < len(order):
            to = at + max(1, BATCH_TOKENS // int(self.size[order[at]]))
            lanes = order[at:to]
            yield lanes, np.searchsorted(-self.size[lanes], -np.arange(self.size[lanes[0]]), side="left")
            at = to


def _products(model: Model, ids: np.ndarray, runs: Runs, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the matrix from the state expected before it to the one expected after it, and log10 of its scale."""
    k = len(model.start)
    products, logs = np.zeros((len(runs.size), k, k)), np.zeros(len(runs.size))
    for lanes, live in runs.lanes(some):
        m, log = np.repeat(np.eye(k)[None], len(lanes), 0), np.zeros(len(lanes))
        starts = runs.start[lanes]
        for t, n in enumerate(live.tolist()):
            np.dot((m[:n] * model.emit[ids[starts[:n] + t]][:, None, :]).reshape(n * k, k), model.move, out=m[:n].reshape(n * k, k))
            if t % SCALED == SCALED - 1 or t + 1 == len(live) or live[t + 1] < n:
                scale = m[:n].reshape(n, -1) @ np.ones(k * k)
                m[:n] /= scale[:, None, None]
                log[:n] += np.log10(scale)
        products[lanes], logs[lanes] = m, log
    return products, logs


def _chained(model: Model, ids: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run the state expected before it and the weight of each state expected after it; log10 likelihoods of texts of several runs."""
    several = runs.last > runs.first
    some = np.flatnonzero(np.repeat(several, runs.last - runs.first + 1))
    products, logs = _products(model, ids, runs, some)
    before = np.repeat(model.start[None], len(runs.size), 0)
    after = np.ones((len(runs.size), len(model.start)))
    log = np.zeros(len(runs.first))
    longest = int((runs.last - runs.first).max(initial=0))
    for k in range(longest + 1):
        own = np.flatnonzero(several & (runs.first + k <= runs.last))
        at = runs.first[own] + k
        ahead = np.einsum("ni,nij->nj", before[at], products[at])
        scale = ahead.sum(1)
        log[own] += np.log10(scale) + logs[at]
        on = at < runs.last[own]
        before[at[on] + 1] = ahead[on] / scale[on, None]
    for k in range(longest):
        at = runs.last - k
        at = at[several & (at > runs.first)]
        behind = np.einsum("nij,nj->ni", products[at], after[at])
        after[at - 1] = behind / behind.sum(1, keepdims=True)
    return before, after, log


def forward_log10(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each class sequence by the scaled forward recursion."""
    runs = Runs.of(sizes)
    out = _chained(model, ids, runs)[2]
    single = runs.last == runs.first
    total = np.zeros(len(runs.size))
    for lanes, live in runs.lanes(runs.first[single]):
        alpha = np.repeat(model.start[None], len(lanes), 0)
        starts, log = runs.start[lanes], np.zeros(len(lanes))
        for t, n in enumerate(live.tolist()):
            a = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[ids[starts[:n] + t]]
            scale = a @ np.ones(len(model.start))
            alpha[:n] = a / scale[:, None]
            log[:n] += np.log10(scale)
        total[lanes] = log
    out[single] = total[runs.first[single]]
    return out


def expected_counts(model: Model, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (classes x states) over the sequences."""
    runs = Runs.of(sizes)
    before, after, _ = _chained(model, ids, runs)
    k = len(model.start)
    begins, goes_on = np.zeros(len(runs.size), bool), np.ones(len(runs.size), bool)
    begins[runs.first], goes_on[runs.last] = True, False
    start, moves, emission = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
    for lanes, live in runs.lanes(np.arange(len(runs.size))):
        starts, ends, ones = runs.start[lanes], runs.size[lanes] - 1, np.ones((k, 1))
        alphas: list[np.ndarray] = []
        emits: list[np.ndarray] = []
        for t, n in enumerate(live.tolist()):
            e = model.emit[ids[starts[:n] + t]]
            a = (alphas[-1][:n] @ model.move if t else before[lanes]) * e
            scale = 1 / (a @ ones)
            a *= scale
            e *= scale
            alphas.append(a)
            emits.append(e)
        last = np.empty((len(lanes), k))
        for t in np.unique(ends).tolist():
            last[ends == t] = alphas[t][np.flatnonzero(ends == t)]
        # weights of the last states, by which forward and backward states add up to 1
        beta = after[lanes] @ model.move.T
        total = (last * beta).sum(1, keepdims=True)
        beta /= total
        over = goes_on[lanes]
        moves += last[over].T @ (after[lanes] / total)[over]
        for t in range(len(alphas) - 1, -1, -1):
            n = live[t]
            if t + 1 < len(alphas):
                m = live[t + 1]
                ahead = emits.pop() * beta[:m]
                moves += alphas[t][:m].T @ ahead
                beta[:m] = ahead @ model.move.T
            alphas[t] *= beta[:n]  # adds up to 1
        start += alphas[0][begins[lanes]].sum(0)
        gammas = np.concatenate(alphas)
        seen = np.concatenate([ids[starts[:n] + t] for t, n in enumerate(live.tolist())])
        for s in range(k):
            emission[s] += np.bincount(seen, gammas[:, s], len(model.emit))
    return start, moves * model.move, emission.T


def _sequences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about BATCH_TOKENS ids, those ids and their sizes."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_TOKENS, side="right")) + at)
            part = batch.slice(at, to - at)
            yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), np.uint16), size[at:to]
            at = to


def baum_welch(sequences: DataFrame, classes: Classes, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Train on a stored table with the binary column ``classes``; one job a round."""
    spark = sequences.sparkSession
    model = Model.initial(classes, states)
    names = ["at", *(f"s{k}" for k in range(states))]
    schema = T.StructType([T.StructField("at", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in names[1:])])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            start, moves, emission = np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape)
            for _, ids, sizes in _sequences(batches, 0):
                for total, part in zip((start, moves, emission), expected_counts(m, ids, sizes), strict=True):
                    total += part
            table = np.rint(np.concatenate([moves[::-1], start[None], emission]) * FIXED).astype(np.int64)
            at = np.arange(-1 - states, len(emission), dtype=np.int32)
            some = table.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[some], *table[some].T)], names)

        sums = sequences.select("classes").mapInArrow(expect, schema).groupBy("at").agg(*(F.sum(x).alias(x) for x in names[1:]))
        model = Model.estimated({r[0]: list(r[1:]) for r in sums.collect()}, classes, states)
        shared.destroy()
    return model


def language_model_scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Rows id, trains, n_tokens, n_known, train_tokens, base_score, score: one per input row.

    A null text counts as empty: its only token is the end. ``trains`` must not be
    null. ``score`` is log10 of the model's probability of the text, ``base_score`` that
    of the add-one unigram. Without training rows every word is unknown and the
    states stay as they were set. Ids may be null or repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), trains.alias("trains"), F.col(text_col).alias("text"))
    counts = stored(word_counts(rows.where("trains"), "text"), "counts")
    classes = learn_classes(counts)
    table = stored(encoded(rows, classes, "text").withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = baum_welch(table.where("trains"), classes, states, rounds)

    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    light = counts.where(F.col("c") * HEAVY < max(classes.tokens, 1))
    sums = rare.join(light, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, sizes in _sequences(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forward_log10(shared.value, ids, sizes))], ["row", "class_score"])

    scored = table.select("row", "classes").mapInArrow(forward, "row long, class_score double")
    table = table.select("row", "id", "trains", "n_tokens", "n_known", "heavy_log", "class_log", "share_log")
    joined = table.join(scored, "row").join(sums, "row", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_log"])
    base = F.col("heavy_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(float(np.log10(classes.tokens + classes.types + 1)))
    score = F.col("class_score") + F.col("class_log") + F.col("rare_log") - F.col("share_log")
    known = (F.col("n_known") + F.col("rare_known")).alias("n_known")
    return joined.select("id", "trains", "n_tokens", known, F.lit(classes.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))

