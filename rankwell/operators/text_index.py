"""An inverted index over several weighted fields, searched by block maxima.

Documents are packed into segments, rows of a stored table with the inverted lists of a few
thousand documents each, in order of length. Nothing but the counts of tokens is shuffled to make them.
A segment's lists are compressed bytes outside the Arrow functions, so what an executor holds of them is
what a file holds, and they are opened one segment at a time.
Queries are packed too; each pack meets each segment in one task, where a posting becomes what
its token adds to the document's score over all fields, so a score is a sum of postings. A first
pass finds a score that k documents surely reach, from each token's best postings. The second
drops the tokens that cannot bring a document there by themselves (stop words, mostly), bounds
every block of a segment from above and reads the postings of those blocks only whose bound
reaches that score. What leaves a task is k rows per query, never a row per query and posting;
the result is that of reading everything.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..functions.vectors import normalised_search_score
from ..sources.writers import scratch, small_batches

#: Documents of a block, and words of a segment (a longer document is one by itself).
BLOCK_DOCS, SEGMENT_WORDS = 128, 1 << 21
#: Segments of a file, which a task reads at once.
FILE_SEGMENTS = 4
#: Queries of a pack.
QUERIES = 1024
#: Postings per token and segment that are its best; also the most results a search can be asked for.
CHAMPIONS = 128
#: Saturation of term frequencies and weight of lengths.
K1, B = 1.2, 0.75
DECIMALS = 6
#: Tokens of all queries up to which packs are broadcast; more of them meet the segments in a plain cross join.
BROADCAST_ROWS = 500_000
#: What rounding may add to a score.
SLACK = 2e-6


@dataclass
class TextIndex:
    """Stored tables: segments (n, sums, body: doc_ids, lengths, tokens, starts, docs, fields, tfs) and words (token, dfs); the type of ids, and what scores are made of."""

    segments: DataFrame
    words: DataFrame
    ids: T.DataType
    weights: list[float]
    means: list[float]
    size: int
    k1: float
    b: float


def _stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df``, with at most ``file_rows`` rows a file, and read it again."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _closed(lists: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed Arrow stream."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()], list(lists))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as stream:
        stream.write_batch(row)
    return out.getvalue().to_pybytes()


def _opened(body: pa.Scalar) -> dict[str, pa.Array]:
    """What ``_closed`` was given."""
    row = pa.ipc.open_stream(body.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {name: row.column(i).flatten() for i, name in enumerate(row.schema.names)}


def _give_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which its worker, which outlives the task, returns free memory to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return run


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _segments(docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row per segment: its documents by length, and for each token its postings (document's place, field, frequency)."""
    rows = docs.select("doc_id", F.array(*(tokens(F.col(name)) for name in fields)).alias("words"))
    width = len(fields)

    def segment(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
        sizes = pc.list_value_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
        order = np.argsort(sizes.sum(1), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded = words.flatten().flatten().dictionary_encode()
        known = coded.dictionary
        sorted_at = pc.sort_indices(known).to_numpy()
        rank = np.empty(len(known), np.int64)
        rank[sorted_at] = np.arange(len(known))
        owner = np.repeat(place[:, None] * width + np.arange(width), sizes.ravel())
        cells = len(order) * width
        found, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * cells + owner, return_counts=True)
        token, owner = np.divmod(found, cells)
        doc, field = np.divmod(owner, width)
        starts = np.searchsorted(token, np.arange(len(known) + 1))
        numbers = {"lengths": sizes[order].ravel().astype(np.int32), "starts": starts.astype(np.int32), "docs": doc.astype(np.int32), "fields": field.astype(np.int8), "tfs": tf.astype(np.int32)}
        body = _closed({"doc_ids": ids.take(pa.array(order)), "tokens": known.take(pa.array(sorted_at)), **{name: pa.array(x) for name, x in numbers.items()}})
        return pa.RecordBatch.from_arrays([pa.array([len(order)]), pa.array([sizes.sum(0)], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["n", "sums", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            each = pc.list_value_length(batch.column(1).flatten()).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width).sum(1)
            at = 0
            while at < batch.num_rows:
                fits = max(int(np.searchsorted(np.cumsum(each[at:]), SEGMENT_WORDS - n, side="right")), 0 if n else 1)
                if fits:
                    held.append(batch.slice(at, fits))
                    n += int(each[at : at + fits].sum())
                    at += fits
                if at < batch.num_rows:
                    yield segment(*(pa.concat_arrays([x.column(c) for x in held]) for c in (0, 1)))
                    held, n = [], 0
        if held:
            yield segment(*(pa.concat_arrays([x.column(c) for x in held]) for c in (0, 1)))

    return rows.mapInArrow(_give_back(pack), "n long, sums array<long>, body binary")


def build_text_index(docs: DataFrame, weights: dict[str, float], k1: float = K1, b: float = B) -> TextIndex:
    """Index doc_id (distinct) and the fields of ``weights``; null fields are empty, and so are documents without a word.

    A field's part of a posting is weight x idf x tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) by field. Postings stay in the task that reads their documents.
    """
    width = len(weights)
    segments = _stored(_segments(docs, list(weights)), "segments", FILE_SEGMENTS)
    sums = segments.agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).first()
    n = sums["n"] or 0
    means = [(sums[f"s{i}"] / n if n else 0) or 1.0 for i in range(width)]
    names = [f"df{i}" for i in range(width)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                row = _opened(body)
                held, starts, fields = row["tokens"], row["starts"].to_numpy(), row["fields"].to_numpy()
                key = np.repeat(np.arange(len(held)), np.diff(starts)) * width + fields
                dfs = np.bincount(key, minlength=len(held) * width).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([held, *(pa.array(dfs[:, f]) for f in range(width))], ["token", *names])

    each = segments.select("body").mapInArrow(_give_back(counted), ", ".join(["token string", *(f"{x} long" for x in names)]))
    words = _stored(each.groupBy("token").agg(*(F.sum(x).alias(x) for x in names)).select("token", F.array(*names).alias("dfs")), "words")
    return TextIndex(segments, words, docs.schema["doc_id"].dataType, list(map(float, weights.values())), means, n, k1, b)


def _asked(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query_id, terms (token and, by field, weight x idf), of the distinct tokens of each query that the index has."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    df = lambda i: F.col("dfs")[i]
    by_field = F.array(*(w * F.log(1 + (index.size - df(i) + 0.5) / (df(i) + 0.5)) for i, w in enumerate(index.weights)))
    terms = asked.join(index.words, "token").select("query_id", F.struct("token", by_field.alias("by_field")).alias("term"))
    return _stored(terms.groupBy("query_id").agg(F.collect_list("term").alias("terms")), "asked")


class _Met:
    """A segment's postings of the tokens that a pack of queries asks for."""

    def __init__(self, segment: dict[str, pa.Array], asked: pa.Array, by_field: np.ndarray, index: tuple):
        means, k1, b, block_docs = index
        width = len(means)
        self.doc_ids = segment["doc_ids"]
        lengths, starts, docs, fields, tfs = (segment[c].to_numpy() for c in ("lengths", "starts", "docs", "fields", "tfs"))
        lengths = lengths.reshape(-1, width)
        coded = asked.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        first = np.unique(self.code, return_index=True)[1]
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=segment["tokens"]), -1).to_numpy(zero_copy_only=False)
        n = np.where(at < 0, 0, starts[at + 1] - starts[at])
        read = np.repeat(np.where(at < 0, 0, starts[at]) - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner, docs, fields, tfs = np.repeat(np.arange(len(at)), n), docs[read], fields[read], tfs[read]
        impact = by_field[first][owner, fields] * tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lengths[docs, fields] / np.array(means)[fields]))
        # the fields of a token in a document are one posting
        new = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(docs, prepend=-1).astype(bool))
        self.docs = docs[new].astype(np.int64)
        self.impacts = np.add.reduceat(impact, new) if len(new) else np.empty(0)
        self.starts = np.searchsorted(owner[new], np.arange(len(at) + 1))
        blocks, owner = self.docs // block_docs, owner[new]
        piece = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(blocks, prepend=-1).astype(bool))
        self.blocks, self.piece_blocks = blocks, blocks[piece]
        self.piece_tops = np.maximum.reduceat(self.impacts, piece) if len(piece) else np.empty(0)
        self.piece_starts = np.searchsorted(owner[piece], np.arange(len(at) + 1))
        self.n_blocks = -(-len(self.doc_ids) // block_docs)
        self.tops = np.array([self.piece_tops[a:z].max() if z > a else 0.0 for a, z in zip(self.piece_starts, self.piece_starts[1:], strict=False)])
        self._best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._rank: np.ndarray | None = None

    def _slice(self, t: int) -> slice:
        return slice(self.starts[t], self.starts[t + 1])

    def _joined(self, terms: list[int], values: np.ndarray) -> np.ndarray:
        return np.concatenate([values[self._slice(t)] for t in terms])

    def sure(self, terms: list[int], k: int) -> np.ndarray:
        """The k best sums of the tokens' best postings: no document has less than its sum."""
        for t in terms:
            if t not in self._best:
                docs, impacts = self.docs[self._slice(t)], self.impacts[self._slice(t)]
                if len(docs) > CHAMPIONS:
                    best = np.argpartition(impacts, len(docs) - CHAMPIONS)[-CHAMPIONS:]
                    docs, impacts = docs[best], impacts[best]
                self._best[t] = docs, impacts
        docs, impacts = (np.concatenate([self._best[t][i] for t in terms]) for i in (0, 1))
        sums = np.bincount(docs, impacts)
        sums = sums[sums > 0]
        return sums if len(sums) <= k else np.partition(sums, len(sums) - k)[-k:]

    def wanted(self, terms: list[int], least: float) -> np.ndarray:
        """Which blocks can hold a document of at least ``least``."""
        tops = self.tops[terms]
        order = np.argsort(tops, kind="stable")
        needed = [terms[i] for i in order[np.cumsum(tops[order]) >= least]]
        pieces = lambda some, values: np.concatenate([values[self.piece_starts[t] : self.piece_starts[t + 1]] for t in some])
        if not needed:
            return np.zeros(self.n_blocks, bool)
        near = np.zeros(self.n_blocks, bool)
        near[pieces(needed, self.piece_blocks)] = True
        return near & (np.bincount(pieces(terms, self.piece_blocks), pieces(terms, self.piece_tops), minlength=self.n_blocks) >= least)

    def read(self, terms: list[int], least: float) -> tuple[int, int]:
        """Postings in the wanted blocks, and all."""
        blocks = self._joined(terms, self.blocks)
        return int(self.wanted(terms, least)[blocks].sum()), len(blocks)

    def best(self, terms: list[int], least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents; ties go to the smaller id."""
        wanted = self.wanted(terms, least)
        if not wanted.any():
            return np.empty(0, np.int64), np.empty(0)
        docs, impacts = self._joined(terms, self.docs), self._joined(terms, self.impacts)
        if not wanted.all():
            here = wanted[self._joined(terms, self.blocks)]
            docs, impacts = docs[here], impacts[here]
        scores = np.round(np.bincount(docs, impacts), DECIMALS)
        found = np.flatnonzero((scores > 0) & (scores >= least))
        if len(found) > k:
            edge = np.partition(scores[found], len(found) - k)[len(found) - k]
            above, level = found[scores[found] > edge], found[scores[found] == edge]
            if self._rank is None:
                self._rank = np.empty(len(self.doc_ids), np.int64)
                self._rank[pc.sort_indices(self.doc_ids).to_numpy()] = np.arange(len(self.doc_ids))
            found = np.append(above, level[np.argsort(self._rank[level])][: k - len(above)])
        return found, scores[found]


def _scanned(index: TextIndex, asked: DataFrame, k: int, what: str) -> DataFrame:
    """Every pack of queries (query_id, terms, least) against every segment: ``sure`` sums, the ``best`` documents, or postings ``read``."""
    packs = max(1, -(-asked.count() // QUERIES))
    told = F.struct("query_id", F.col("terms.token").alias("tokens"), F.col("terms.by_field").alias("by_field"), "least")
    packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")).agg(F.collect_list(told).alias("q"))
    packed = _stored(packed.select(*(F.col(f"q.{c}").alias(f"q_{c}") for c in ("query_id", "tokens", "by_field", "least"))), "packs")
    few = (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_ROWS
    pairs = index.segments.select("body").crossJoin(F.broadcast(packed) if few else packed)
    query_id, doc_id = T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", index.ids)
    found = {"sure": [T.StructField("sure", T.DoubleType())], "best": [doc_id, T.StructField("score", T.DoubleType())], "read": [T.StructField("wanted", T.LongType()), T.StructField("listed", T.LongType())]}[what]
    schema, settings, width = T.StructType([query_id, *found]), (index.means, index.k1, index.b, BLOCK_DOCS), len(index.weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j).slice(i, 1) for j, name in enumerate(batch.schema.names)}
                lists = row["q_tokens"].flatten()
                met = _Met(_opened(row["body"][0]), lists.flatten(), _values(row["q_by_field"].flatten().flatten()).reshape(-1, width), settings)
                least, ends = _values(row["q_least"]), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                owners, out = [], []
                for q, (end, floor) in enumerate(zip(ends.tolist(), least.tolist(), strict=True)):
                    terms = [t for t in met.code[ends[q - 1] if q else 0 : end].tolist() if met.tops[t] > 0]
                    if terms:
                        rows = (met.sure(terms, k),) if what == "sure" else met.best(terms, floor, k) if what == "best" else [np.array([x]) for x in met.read(terms, floor)]
                        owners.append(np.full(len(rows[0]), q))
                        out.append(rows)
                if out:
                    columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                    if what == "best":
                        columns[0] = met.doc_ids.take(columns[0])
                    yield pa.RecordBatch.from_arrays([row["q_query_id"].flatten().take(pa.array(np.concatenate(owners))), *columns], schema.names)

    return pairs.mapInArrow(_give_back(scan), schema)


def _bounded(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, terms, least: what k documents surely score, for each query that has a token of the index."""
    if k > CHAMPIONS:
        raise ValueError(f"at most {CHAMPIONS} results")
    asked = _asked(index, queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("sure"))
    # the cut goes into the tasks before the shuffle, so a query sends k rows a task at most
    sure = _scanned(index, asked.withColumn("least", F.lit(0.0)), k, "sure").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).where(F.col("nth") == k)
    sure = sure.select("query_id", (F.col("sure") - SLACK).alias("least"))
    return _stored(asked.join(sure, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "bounded")


def text_topk(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, ord: the k documents of the greatest sums for each query (query_id, text); ties go to the smaller id.

    Only documents with a score over 0 come out. Queries that are null or have no known word get nothing.
    """
    scores = _scanned(index, _bounded(index, queries, k), k, "best")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return _stored(scores.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k), "found")


def postings_read(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, wanted, listed: postings that a search reads, and those of all its tokens."""
    read = _scanned(index, _bounded(index, queries, k), k, "read")
    return _stored(read.groupBy("query_id").agg(F.sum("wanted").alias("wanted"), F.sum("listed").alias("listed")), "read")


def scaled(hits: DataFrame) -> DataFrame:
    """Hits on a scale of 0 to 1 and in its order: scores over 1 count a tenth, 1 at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_ord")
    rows = hits.withColumnRenamed("ord", "raw_ord").withColumn("score", F.round(normalised_search_score(F.col("score")), DECIMALS))
    return rows.withColumn("ord", F.row_number().over(w)).drop("raw_ord")


def search_allowed(index: TextIndex, queries: DataFrame, titles: DataFrame, allowed: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of twice as many hits whose title (doc_id, title) is in the caller's list (title), compared without case."""
    key = lambda c: F.lower(F.trim(c)).alias("_key")
    names = allowed.select(key(F.col("title"))).where("_key <> ''").distinct()
    hits = text_topk(index, queries, 2 * limit).join(titles.select("doc_id", key(F.col("title"))), "doc_id").join(names, "_key", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.select("query_id", "doc_id", "score").withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit)
