"""Exact Jaccard self-join on word n-grams by T-occurrence search.

1. Every text becomes its set of distinct shingles (64-bit hashes). Equal sets are one
   node from here on, so copies cost nothing more.
2. Inverted lists are merged by counting, and a pair that shares fewer than it must cannot
   link. What a list stands for depends on the threshold:
   * From GROUPED per cent on the lists are of groups of shingles. The hashes' range is cut
     into D + t equal parts, D being the most shingles that two linked sets of the size
     class may have apart: these fall into at most D parts, so the sets are equal in t of
     them. A group of several shingles is hardly ever shared by strangers, however large
     the corpus is and whatever its frequent words are.
   * Below it a set of n shingles needs T = ceil(threshold * n) of them in any partner, so
     T - K of its own lists can be set aside, and a partner still shares K of the others
     with it. All sets set aside the last ones of one order: by hash, and behind all others
     the shingles that hold 1/HEAVY of all shingles or more, which are the longest lists.
   Lists of over LONG nodes are set aside there too and lower the count that is asked
   for by as many as the node has of them; only nodes with so many that the others need
   not show a link are tied to the long lists, by stars, never by pairs.
3. What is left is verified by T-occurrence search in whole sets, grouped by the connected
   parts of the candidates: the longest L lists of a query are set aside, the short ones are
   merged on a heap, documents that come up T - L times are probed in the long ones by
   binary search (DivideSkip). Pairs that are already connected are not compared again.
4. In a part of over SMALL nodes the most shared nodes are searched against all others
   first; then every node that is not in the part's largest connected piece is. Any
   unconnected pair has such a node, so no link is lost. Nodes are dealt to blocks and
   queries to runs, so that no task holds more than one of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, giving_back, power_of_two, released, remove, stored, told_by_group
from .components import components
from .exact_dedup import BITS_PER_ROW, BLOCK_BITS, BROADCAST_BYTES, hit_cells, probed

SMALL = 64
#: Nodes of a large part that are searched together, and nodes that ask them together.
BLOCK = 512
QUERIES = 1024
#: Nodes of a large part that are searched first, in each of PIVOT_ROUNDS rounds.
PIVOTS = 4
PIVOT_ROUNDS = 2
#: Per cent from which lists of groups of shingles are merged. Groups hold about percent / (100 - percent) shingles.
GROUPED = 85
#: Ratio of the sizes in a class of sets that are cut into the same parts, as 5 / 4.
CLASS = (5, 4)
#: Linked sets are equal in 2 parts, and in one more for so many shingles that they may have apart.
APART = 16
#: Shingles with at least 1/HEAVY of all come last in the order; there are at most HEAVY.
HEAVY = 1 << 18
#: Shingles that are counted together when heavy ones are looked for. Bounds memory only.
COUNTED = 1 << 21
#: Bytes of a block after whose search memory is given back.
LARGE_BLOCK = 8 << 20
#: Nodes in a list that is merged by counting; longer lists are set aside.
LONG = 32
#: Total length of lists up to which they are merged on a heap; longer ones are merged into an array of counts.
HEAP = 4096
#: Weight of a list's logarithmic length in the number of lists that DivideSkip sets aside.
SKIP_WEIGHT = 0.3
_MEMORY_WORDS = 200_000
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct n-word shingles of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Words are lower-cased (A-Z) runs without ASCII white space; fewer than n words are one shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            new = {w: xxhash.xxh3_64_intdigest(w) for w, h in zip(words, found, strict=True) if h is None}
            found = [new[w] if h is None else h for w, h in zip(words, found, strict=True)]
            if len(self.known) + len(new) > _MEMORY_WORDS:
                self.known.clear()
            self.known.update(new)
        h = np.array(found, np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _M3 + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def set_aside(n: int, percent: int) -> int:
    """How many of a set's n lists are set aside: K less than any partner must share."""
    least = -(-percent * n // 100)
    return max(0, least - 1 - (n - least) // 2)


def indexed(shingles: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The shingles (sorted by hash) whose lists are merged; ``heavy`` (sorted) come last in the order."""
    kept = len(shingles) - set_aside(len(shingles), percent)
    if len(heavy):
        last = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[:kept]


def size_classes(least: int, most: int) -> Iterator[int]:
    """The largest sizes of the classes that hold the sizes from ``least`` to ``most``."""
    top = 0
    while top < most:
        top = max(top + 1, (top + 1) * CLASS[0] // CLASS[1])
        if top >= least:
            yield top


def group_parts(top: int, percent: int) -> tuple[int, int]:
    """Into how many parts sets of a class are cut, and in how many at least two linked sets are equal of which the smaller is in the class.

    At most (100 - percent) / percent of the smaller set's size are in one of the two only; where that is none, linked sets are equal, and nothing is cut.
    """
    apart = top * (100 - percent) // percent
    equal = 2 + apart // APART
    return (apart + equal, equal) if apart else (0, equal)


def groups(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of a set's (sorted) groups in the classes of all sets that it may link with and that are not larger."""
    sums = np.append(np.uint64(0), np.cumsum(_mix(shingles * _M1), dtype=np.uint64))
    out = [np.empty(0, np.uint64)]
    for top in size_classes(-(-percent * len(shingles) // 100), len(shingles)):
        parts, _ = group_parts(top, percent)
        if parts:
            at = np.arange(parts, dtype=np.uint64)
            ends = sums[np.append(np.searchsorted(shingles, at * np.uint64((1 << 64) // parts)), len(shingles))]
            out.append(_mix((ends[1:] - ends[:-1]) ^ _mix(at + np.full(parts, top, np.uint64) * _M3)))
    return np.concatenate(out)


def groups_asked(n: int, percent: int) -> tuple[int, int]:
    """How many groups a set of n shares with a linked set that is not smaller, and with any linked set, at least."""
    equal = [group_parts(top, percent)[1] for top in size_classes(-(-percent * n // 100), n)]
    return equal[-1], equal[0]


def lists_asked(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's n lists are set aside, and how many of the others it shares with any linked set, at least."""
    least = -(-percent * n // 100)  # a partner has as many shingles at least
    return set_aside(n, percent), -(-percent * least // 100) - set_aside(least, percent)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    one, two = _mix(shingles * _M1), _mix(shingles ^ _M2)
    return int(one.sum(dtype=np.uint64).view(np.int64)), int((two.sum(dtype=np.uint64) ^ np.uint64(len(shingles))).view(np.int64))


def _links_enough(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


class InvertedLists:
    """The inverted lists of a block of sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(order))
        self.sizes = np.array([len(s) for s in sets])

    def search(self, query: np.ndarray, percent: int, skip=None) -> list[int]:
        """Sets that link with ``query``; those for which skip(set) holds are not probed."""
        n = len(query)
        least = -(-percent * n // 100)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        here = self.keys[at] == query
        if here.sum() < least:
            return []
        at, grams = at[here], query[here]
        length = self.first[at + 1] - self.first[at]
        order = np.argsort(length, kind="stable")
        aside = min(least - 1, int(least / (SKIP_WEIGHT * log2(int(length.max()) + 1) + 1)))
        short = at[order[: len(order) - aside]].tolist()
        long = np.sort(grams[order[len(order) - aside :]])
        found: list[int] = []
        for d, times in self._merged([self.owner[self.first[k] : self.first[k + 1]] for k in short], least - aside):
            m = int(self.sizes[d])
            if 100 * min(n, m) < percent * max(n, m) or (skip and skip(d)):
                continue
            if _links_enough(times + self._probe(d, long), n, m, percent):
                found.append(d)
        return found

    def _probe(self, d: int, grams: np.ndarray) -> int:
        """How many of the grams' lists hold set d, by binary search."""
        own = self.sets[d]
        return int((own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams).sum()) if len(grams) else 0

    def _merged(self, lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
        """Sets that ``least`` or more of the short lists hold, in ascending order, and how many do."""
        if sum(map(len, lists)) > HEAP:
            times = np.bincount(np.concatenate(lists), minlength=len(self.sets))
            enough = np.flatnonzero(times >= least)
            yield from zip(enough.tolist(), times[enough].tolist(), strict=True)
            return
        last, times = -1, 0
        for d in heapq.merge(*(x.tolist() for x in lists)):
            if d != last:
                if times >= least:
                    yield last, times
                last, times = d, 0
            times += 1
        if times >= least:
            yield last, times


class _Sets:
    """Disjoint sets of a block's members."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _search_block(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that connect a block: its queries against its data, or its data against themselves."""
    nodes, labels, asks = (table[c].to_pylist() for c in ("node", "label", "asks"))
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    seen: set[tuple[int, bool]] = set()
    data, queries = [], []
    for k, key in enumerate(zip(nodes, asks, strict=True)):
        if key not in seen:
            seen.add(key)
            (queries if asks[k] else data).append(k)
    if not data:
        return []
    known = _Sets(labels)
    index = InvertedLists([sets[k] for k in data])
    out = []
    for q in queries or data:
        for d in index.search(sets[q], percent, lambda d, q=q: nodes[data[d]] == nodes[q] or known.find(data[d]) == known.find(q)):
            known.join(data[d], q)
            out.append((nodes[q], nodes[data[d]]))
    return out


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """Edges a, b found in the groups (comp, block, run) of rows with node, label, asks, shingles."""

    def search(table: pa.Table) -> pa.Table:
        found = _search_block(table, percent)
        if table.nbytes >= LARGE_BLOCK:
            give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("comp", "block", "run").applyInArrow(search, "a long, b long")


def _in_blocks(asking: DataFrame, told: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges of the ``asking`` nodes (comp, node, label) with all nodes of their parts, dealt to blocks; queries go to the blocks in runs."""
    asked = asking.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("runs"))
    shape = stored(asked.join(sizes, "comp").select("comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "runs"), "shape")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = told.join(shape, "comp").select("comp", dealt("blocks").alias("block"), every("runs").alias("run"), "node", "label", F.lit(False).alias("asks"))
    asks = asking.join(shape, "comp").select("comp", every("blocks").alias("block"), dealt("runs").alias("run"), "node", "label", F.lit(True).alias("asks"))
    return _searched(data.unionByName(asks).join(sets, "node"), percent)


def _fewest_shared(percent: int, a: Column, b: Column) -> Column:
    """How many short lists two linked sets share at least; a, b: structs with n, own, long.

    Groups: the smaller set's class says how many. Shingles: of two sets the one whose kept
    lists end first in the order has all it may share beyond them in its lists set aside.
    """
    needed = F.ceil(percent * (a["n"] + b["n"]) / (100 + percent) - 1e-9) - F.greatest(a["own"], b["own"])
    return ((F.least(a["own"], b["own"]) if percent >= GROUPED else needed) - F.least(a["long"], b["long"])).cast("int")


def _links_of_large(nodes: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges that connect large candidate parts; nodes: comp, node, weight."""
    sets = sets.select("node", "shingles")
    told = nodes.withColumn("label", F.col("node"))
    edges = None
    for turn in range(PIVOT_ROUNDS + 1):
        told = stored(told, "told")
        pieces = told.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
        main = pieces.groupBy("comp").agg(F.max(F.struct("n", "label")).alias("m")).select("comp", F.col("m.label").alias("main"))
        rest = told if turn == 0 else told.join(main, "comp").where("label <> main").drop("main")
        if turn < PIVOT_ROUNDS:
            best = rest.groupBy("comp", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("turn")).agg(F.max(F.struct("weight", "node", "label")).alias("m"))
            rest = best.select("comp", F.col("m.node").alias("node"), F.col("m.label").alias("label"))
        asking = stored(rest.select("comp", "node", "label"), "asking")
        if asking.isEmpty():
            break
        found = stored(_in_blocks(asking, told.select("comp", "node", "label"), sets, sizes, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        if turn < PIVOT_ROUNDS:
            told = nodes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return edges


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From node, n_shingles, own, fewest, parts: the candidates' connected parts (node, label), and each node's number of shared lists (node, weight)."""
    spark = nodes.sparkSession
    each = nodes.select("node", F.explode("parts").alias("part"))
    lists = stored(each.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    blocks = power_of_two(lists.count() * BITS_PER_ROW / BLOCK_BITS)
    cells = stored(hit_cells(lists.select(F.col("part").alias("digest")), blocks, 1), "cells")
    released(spark)
    # most parts are in no list: the filter keeps them out of the shuffle
    some = probed(each.withColumn("digest", F.col("part")), cells, blocks, blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES).where("possible").select("node", "part")
    shared = stored(some.join(lists, "part"), "shared")
    remove(lists)
    weights = shared.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.count_if(F.col("size") > LONG).alias("long"))
    about = stored(nodes.select("node", F.col("n_shingles").alias("n"), "own", "fewest").join(weights, "node"), "about")
    released(spark)

    # pairs of the short lists, at most LONG nodes each; what a pair is asked for is told where it is made
    member = F.struct("node", "n", "own", "long").alias("member")
    short = shared.where(F.col("size") <= LONG).select("node", "part").join(about.select("node", member), "node")
    short = short.groupBy("part").agg(F.array_sort(F.collect_list("member")).alias("l"))
    alike = lambda a, b: 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    pair = lambda a, b: F.struct(a["node"].alias("a"), b["node"].alias("b"), _fewest_shared(percent, a, b).alias("asked"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.filter(F.slice(F.col("l"), i + 2, LONG), lambda b: alike(a, b)), lambda b: pair(a, b))))
    counted = short.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"), F.max("p.asked").alias("asked"))
    near = stored(counted.where(F.col("shared") >= F.col("asked")).select("a", "b"), "near")

    tied = about.where(F.col("long") >= F.col("fewest")).select("node")
    held = stored(shared.where(F.col("size") > LONG).select("node", "part").join(tied, "node", "left_semi"), "held")
    hubs = held.groupBy("part").agg(F.min("node").alias("hub"))
    stars = held.join(hubs, "part").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    remove(shared)
    released(spark)
    found = components(near.unionByName(stars))
    return found, about.select("node", "weight")


def heavy_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that hold 1/HEAVY or more of all (counted in ``rows``' column text); at most HEAVY.

    Tasks count COUNTED shingles at a time and pass on those with their share of 1/HEAVY; a
    heavy shingle has it somewhere, and parts below it are left out. So this is a lower
    bound of the counts, which serves since any order of the shingles gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled, held, size = Shingler(words), [], 0

        def passed_on() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times * HEAVY >= max(size, 2 * HEAVY)
            out = [np.append(grams[often].view(np.int64), 0), np.append(times[often], size), np.append(np.zeros(often.sum(), bool), True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["gram", "n", "total"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingled(text.as_py()))
                size += len(held[-1])
                if size >= COUNTED:
                    yield passed_on()
                    size = 0
        if held:
            yield passed_on()

    sums = stored(rows.select("text").mapInArrow(giving_back(count), "gram long, n long, total boolean").groupBy("gram", "total").agg(F.sum("n").alias("n")), "heavy")
    n = sums.where("total").agg(F.sum("n")).first()[0] or 0
    found = sums.where(~F.col("total") & (F.col("n") * HEAVY >= n)).select("gram").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_shingles, component_id: one per input row.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of
    distinct shingles of ``words`` words. component_id is the smallest id that links reach,
    itself included. Texts that are null or have no word have no shingle and link with
    nothing. Null ids count as larger than all others (a component of null ids has a null
    component_id). Rows with equal ids are told apart by their sets only. An empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = rows.schema["id"]

    grouped = percent >= GROUPED
    frequent = docs.sparkSession.sparkContext.broadcast(np.empty(0, np.uint64) if grouped else heavy_shingles(rows, words))  # at most HEAVY hashes

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled, heavy = Shingler(words), frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingled(text.as_py()) for text in batch.column(1)]
                digests = [set_digest(s) if len(s) else (0, 0) for s in sets]
                parts = [groups(s, percent) if grouped else indexed(s, heavy, percent) for s in sets]
                asked = [(groups_asked if grouped else lists_asked)(len(s), percent) if len(s) else (0, 0) for s in sets]
                ends = np.cumsum([0, *map(len, parts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                arrays = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in of], pa.int64()) for of in (digests, asked) for k in (0, 1)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *names, "parts"])

    names = ("n_shingles", "d1", "d2", "own", "fewest")
    longs = [T.StructField(x, T.LongType()) for x in names]
    signed_rows = rows.mapInArrow(giving_back(signed), T.StructType([id_field, *longs, T.StructField("parts", T.ArrayType(T.LongType()))]))
    signed_rows = stored(signed_rows.withColumn("node", F.monotonically_increasing_id()), "signed")
    total = signed_rows.count()
    each = stored(signed_rows.select("id", "n_shingles", "d1", "d2", "node"), "each")
    # one node for each set: the first of its rows
    sets = each.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("node").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets, "sets")
    # the other rows of a set are left out; only rows that may be among these move
    again = stored(each.where("n_shingles > 0").select("node").join(sets.select("node"), "node", "left_anti").withColumn("digest", F.col("node")), "again")
    blocks = power_of_two(again.count() * BITS_PER_ROW / BLOCK_BITS)
    seen = signed_rows.select("node", "n_shingles", "own", "fewest", "parts", F.col("node").alias("digest"))
    seen = probed(seen, stored(hit_cells(again, blocks, 1), "cells"), blocks, blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES).drop("digest")
    nodes = seen.where("NOT possible").unionByName(seen.where("possible").join(again.select("node"), "node", "left_anti"))
    released(docs.sparkSession)
    comps, weights = _candidates(nodes, percent)
    comps = stored(comps.join(weights, "node").withColumnRenamed("label", "comp"), "candidates")
    del nodes, seen
    remove(signed_rows)
    released(docs.sparkSession)

    # the candidates' shingles, from their whole texts again
    wanted = stored(comps.join(each, "node").select("node", "comp", "id", "d1", "d2"), "wanted")

    def shingled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(words)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [shingled(t.as_py()) for t in batch.column(1)]
                digests = [set_digest(s) if len(s) else (0, 0) for s in found]
                arrays = [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array([s.tobytes() for s in found], pa.binary())], ["id", "d1", "d2", "shingles"])

    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("digest")
    blocks = power_of_two(wanted.count() * 16 / BLOCK_BITS)
    cells = hit_cells(wanted.select(key), blocks, 1)
    fetched = probed(rows.withColumn("digest", key), cells, blocks, blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES).where("possible").select("id", "text")
    fetched = fetched.mapInArrow(giving_back(shingled_rows), T.StructType([id_field, *longs[1:3], T.StructField("shingles", T.BinaryType())]))
    left, right = fetched.alias("f"), wanted.alias("w")
    same = F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.d1") == F.col("w.d1")) & (F.col("f.d2") == F.col("w.d2"))
    found = stored(left.join(right, same).select("w.node", "w.comp", "f.shingles"), "shingles")
    released(docs.sparkSession)

    sizes = stored(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    small = found.join(sizes.where(F.col("size") <= SMALL), "comp")
    zero = F.lit(0)
    links = _searched(small.select("comp", zero.alias("block"), zero.alias("run"), "node", F.col("node").alias("label"), F.lit(False).alias("asks"), "shingles"), percent)
    links = stored(links, "links")
    large = stored(sizes.where(F.col("size") > SMALL), "large")
    if not large.isEmpty():
        nodes = stored(comps.join(large.select("comp"), "comp", "left_semi").select("comp", "node", "weight"), "large")
        # its rounds shuffle the sets of large parts only
        whole = stored(found.join(large.select("comp"), "comp", "left_semi"), "whole")
        links = links.unionByName(_links_of_large(nodes, whole, large, percent))

    labels = components(links)
    labelled = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    reached = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "reached")
    labelled = told_by_group(labelled.select("d1", "d2", "label", "copies"), reached, ["label"], "n", sets.count()).select("d1", "d2", "copies", "component_id")
    worded = each.where("n_shingles > 0").select("id", "n_shingles", "d1", "d2")
    told = told_by_group(worded, stored(labelled, "told"), ["d1", "d2"], "copies", total).select("id", "n_shingles", "component_id")
    return told.unionByName(each.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and texts without words.

    Rows that share an id stay or go together.
    """
    told = ngram_components(docs, words, percent, id_col, text_col)
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    gone = stored(told.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__gone"), key.alias("digest")).distinct(), "gone")
    blocks = power_of_two(gone.count() * BITS_PER_ROW / BLOCK_BITS)
    cells = stored(hit_cells(gone, blocks, 1), "cells")
    # only rows whose id may be among those that go are shuffled
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("digest"))
    seen = stored(probed(rows, cells, blocks, blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES).where("possible").select("row"), "seen")
    stay = seen.join(gone, seen[f"row.{id_col}"].eqNullSafe(gone["__gone"]), "left_anti")
    return probed(rows, cells, blocks, blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES).where("NOT possible").select("row.*").unionByName(stay.select("row.*"))
