"""Vector search for any number of queries: blocks against blocks, in full or in the nearest lists of an index.

Vectors are packed into rows of a few thousand under a key, and so are queries; rows of one
key meet in a join and are multiplied as matrices. What leaves a pair of rows is its k best
per query, never a score per pair of vectors, and nothing passes through the driver.

* In full: keys are fragments of the corpus, and every query is sent to each fragment.
* Indexed: keys are the lists of a coarse quantiser, and a query is sent to its nearest lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import biased
from ..sources.writers import scratch

#: Vectors in a row of the corpus, and queries in a row of queries.
CHUNK, BLOCK = 2048, 1024
#: Vectors of a fragment at least and at most, where the whole corpus is searched.
FRAGMENT, LARGEST_FRAGMENT = 4096, 1 << 18
#: Fragments that are made only to have enough tasks.
TASKS = 256
#: Lists of an index at most, and vectors that its quantiser is fitted on at most. Every vector is in a list.
MOST_LISTS, SAMPLE = 4096, 65_536
#: Queries at most that the number of probed lists is measured on.
MEASURED = 256
#: Cosines and coordinates that a task computes at a time. Bounds memory only.
CELLS = 1 << 20
DECIMALS = 6


def units(m: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero row stays zero."""
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def best_pairs(names: pa.Array, q: np.ndarray, ids: pa.Array, m: np.ndarray, k: int, exclude_self: bool, decimals: int) -> Iterator[list[pa.Array]]:
    """query ids, corpus ids and cosines of each query's k best among ``ids``; q and m are unit rows. Ties go to the smaller id.

    Cosines are held for as many queries at a time as make ``CELLS`` of them, so memory grows with neither side.
    """
    place = {d: i for i, d in enumerate(ids.to_pylist())} if exclude_self else {}
    most = min(len(ids), k)
    wide = max(1, CELLS // len(ids))
    for at in range(0, len(names), wide):
        own = names.slice(at, wide)
        s = m @ q[at : at + wide].T
        np.round(np.clip(s, -1, 1, out=s), decimals, out=s)
        for j, name in enumerate(own.to_pylist()):
            if name in place:
                s[place[name], j] = -2
        edges = np.partition(s, len(ids) - most, axis=0)[len(ids) - most].copy()
        owners, rows = [], []
        for j in range(len(own)):
            best = np.flatnonzero((s[:, j] >= edges[j]) & (s[:, j] >= -1))
            if len(best) > most:
                best = np.array(sorted(best.tolist(), key=lambda i, j=j: (-s[i, j], ids[i].as_py()))[:most])
            owners.append(np.full(len(best), j))
            rows.append(best)
        owners, rows = np.concatenate(owners), np.concatenate(rows)
        yield [own.take(pa.array(owners)), ids.take(pa.array(rows)), pa.array(s[rows, owners])]


def result_schema(corpus: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", corpus.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])


def whole(vectors: DataFrame, id_col: str, size: int) -> DataFrame:
    """id_col, embedding without null ids, null vectors and those of another size or with a null, NaN or infinity in them."""
    e = F.col("embedding").cast("array<float>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(id_col, e.alias("embedding")).where(F.col(id_col).isNotNull() & (F.size(e) == size) & sound)


def _packed(rows: DataFrame, id_col: str, size: int, key: str = "key") -> DataFrame:
    """One row per ``size`` vectors of a key or so: key, ids, vectors.

    Hashes of the ids say which row a vector is in, so copies of an id share a row.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    # keys are fragments or lists, which are bounded in number; so is this broadcast
    told = rows.join(F.broadcast(counts), key).withColumn("_part", F.pmod(F.xxhash64(F.col(id_col)), F.expr(f"_n DIV {size} + 1")))
    return told.groupBy(key, "_part").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "embedding")).alias("_held")).select(key, F.col("_held.id").alias(f"{id_col}s"), F.col("_held.embedding").alias(f"{id_col}_vectors"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """One list of equal vectors as unit rows in double precision."""
    flat = pc.list_flatten(pc.list_flatten(vectors)).to_numpy(zero_copy_only=False)
    return units(np.asarray(flat, np.float64).reshape(len(pc.list_flatten(vectors)), -1))


def _met(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool, decimals: int, schema: T.StructType) -> DataFrame:
    """The k best of each query in each pair of packed rows, and of those the k best."""
    query_type = to_arrow_type(schema["query_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, docs, query_ids, asked = (batch.column(c).slice(i, 1) for c in ("doc_ids", "doc_id_vectors", "query_ids", "query_id_vectors"))
                names = pc.list_flatten(query_ids).cast(query_type)
                for found in best_pairs(names, _matrix(asked), pc.list_flatten(doc_ids), _matrix(docs), k, exclude_self, decimals):
                    yield pa.RecordBatch.from_arrays(found, schema.names)

    pairs = corpus.join(queries, "key").select("doc_ids", "doc_id_vectors", "query_ids", "query_id_vectors")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return pairs.mapInArrow(score, schema).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)


def block_topk(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, decimals: int = DECIMALS) -> DataFrame:
    """query_id, doc_id, score, ord: the exact k nearest, for query sets of any size.

    The corpus moves once, in fragments; the queries move once for each fragment. The size of the plan
    depends on neither. See :func:`whole` for what is left out; an empty side gives no rows.
    """
    first = queries.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    schema = result_schema(corpus, queries)
    if first is None:
        return corpus.sparkSession.createDataFrame([], schema).withColumn("ord", F.lit(1))
    own, asked = whole(corpus, "doc_id", first[0]), whole(queries, "query_id", first[0])
    n = corpus.count()
    fragments = max(1, -(-n // LARGEST_FRAGMENT), min(TASKS, n // FRAGMENT))
    own = _packed(own.withColumn("key", F.pmod(F.xxhash64(F.lit("fragment"), "doc_id"), F.lit(fragments)).cast("int")), "doc_id", CHUNK)
    blocks = _packed(asked.withColumn("key", F.lit(0)), "query_id", BLOCK)
    blocks = blocks.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    return _met(own, blocks, k, exclude_self, decimals, schema)


@dataclass
class VectorIndex:
    """Vectors in the lists of a coarse quantiser: the stored rows (key, doc_ids, doc_id_vectors), the centres and the vectors' number."""

    lists: DataFrame
    centres: np.ndarray
    size: int
    corpus: DataFrame

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]


def _nearest(rows: DataFrame, id_col: str, centres: np.ndarray, probes: int) -> DataFrame:
    """id_col, embedding, key: each vector once for each of its ``probes`` nearest centres, the nearest first (``nth``)."""
    schema = T.StructType([*rows.select(id_col, "embedding").schema.fields, T.StructField("key", T.IntegerType()), T.StructField("nth", T.IntegerType())])
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = units(np.asarray(pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1))
            s = m @ c.T
            most = min(probes, len(c))
            keys = np.argsort(-s, axis=1, kind="stable")[:, :most] if most > 1 else s.argmax(1)[:, None]
            at = pa.array(np.repeat(np.arange(batch.num_rows), most))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys.ravel().astype(np.int32)), pa.array(np.tile(np.arange(most, dtype=np.int32), batch.num_rows))], schema.names)

    return rows.select(id_col, "embedding").mapInArrow(assign, schema)


def build_index(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 11) -> VectorIndex:
    """Index doc_id, embedding: k-means on a bounded sample, then every vector goes to its nearest centre's list.

    ``lists`` is the square root of the vectors' number by default. The sample holds at most ``sample``
    vectors, chosen by a hash of the id. Lists are stored in rows of ``CHUNK`` vectors, so a list that holds
    a third of the corpus is many rows. Null and odd vectors are left out as in :func:`whole`.
    """
    spark = corpus.sparkSession
    first = corpus.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    size = first[0] if first else 1
    own = whole(corpus, "doc_id", size)
    n = own.count()
    lists = min(MOST_LISTS, max(1, lists or round(n**0.5)))
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20))
    some = own.where(share).limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    centres = np.zeros((1, size)) if n < 2 * lists or lists == 1 else np.array(KMeans(k=lists, maxIter=6, seed=seed, initMode="random").fit(some).clusterCenters())
    centres = units(centres)
    path = scratch(spark, "vector-lists")
    packed = _packed(_nearest(own, "doc_id", centres, 1), "doc_id", CHUNK)
    packed.sortWithinPartitions("key").write.parquet(path)
    return VectorIndex(spark.read.schema(packed.schema).parquet(path), centres, n, corpus)


def index_topk(index: VectorIndex, queries: DataFrame, k: int, probes: int, exclude_self: bool = True, decimals: int = DECIMALS) -> DataFrame:
    """query_id, doc_id, score, ord: the k best in each query's ``probes`` nearest lists; exact if these are all lists."""
    asked = _nearest(whole(queries, "query_id", index.dimensions), "query_id", index.centres, probes)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", index.lists.schema["doc_ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    return _met(index.lists, _packed(asked.drop("nth"), "query_id", BLOCK), k, exclude_self, decimals, schema)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95, most: int = MEASURED) -> int:
    """The fewest lists in which a share ``recall`` of the true neighbours of a bounded sample of queries lie.

    At most ``most`` queries are searched exactly, and the rank of each neighbour's list among the query's is taken.
    """
    some = queries.orderBy(F.xxhash64("query_id")).limit(most)
    truth = block_topk(index.corpus, some, k).select("query_id", "doc_id")
    home = _nearest(whole(index.corpus, "doc_id", index.dimensions), "doc_id", index.centres, 1).select("doc_id", "key")
    order = _nearest(whole(some, "query_id", index.dimensions), "query_id", index.centres, len(index.centres)).select("query_id", "key", "nth")
    # most * k neighbours at most
    ranks = truth.join(home, "doc_id").join(order, ["query_id", "key"]).groupBy("nth").agg(F.count(F.lit(1)).alias("n")).orderBy("nth").collect()
    total, held = sum(r["n"] for r in ranks), 0
    for r in ranks:
        held += r["n"]
        if held >= recall * total:
            return r["nth"] + 1
    return len(index.centres)


@dataclass
class Collection:
    """A collection to search: doc_id, embedding; optionally children (doc_id, child_id, embedding) and a bias per doc_id (doc_id, bias)."""

    docs: DataFrame | None = None
    children: DataFrame | None = None
    bias: DataFrame | None = None


def search_collections(collections: dict[str, Collection], queries: DataFrame, k: int, k_children: int, find) -> DataFrame:
    """collection, query_id, doc_id, score, ord: the k best of every collection.

    ``find(rows, queries, k)`` searches doc_id, embedding, in full or by an index. A document with a hit of
    a child takes the child's score even if it is lower; ``k_children`` child hits count. A bias is added and the sum
    kept in [0, 1] before the cut; collections without one keep plain cosines. A collection without docs gives no rows.
    """
    out = None
    for name, c in collections.items():
        if c.docs is None:
            continue
        rows = find(c.docs, queries, k).select("query_id", "doc_id", "score")
        if c.children is not None:
            # ids of children are found, and told their documents after the cut
            kids = find(c.children.select(F.col("child_id").alias("doc_id"), "embedding"), queries, k_children).select("query_id", F.col("doc_id").alias("child_id"), "score")
            kids = kids.join(c.children.select("child_id", "doc_id"), "child_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("child"))
            rows = rows.join(kids, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.coalesce("child", "score").alias("score"))
        if c.bias is not None:
            rows = rows.join(c.bias.select("doc_id", "bias"), "doc_id", "left").select("query_id", "doc_id", F.round(biased(F.col("score"), F.col("bias")), DECIMALS).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        rows = rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k).select(F.lit(name).alias("collection"), "query_id", "doc_id", "score", "ord")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else queries.sparkSession.createDataFrame([], "collection string, query_id long, doc_id long, score double, ord int")
