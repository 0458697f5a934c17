"""Variable-capacity best-fit packing of token runs into training sequences.

Runs are placed longest first into the open bin that they leave fullest. Where none
fits, the bin size that costs least per token it can still be given is opened; finally
every bin is cut down to the smallest permitted length that holds its contents. Each
group of runs is packed once for every permitted largest size, and the plan with the
least total cost stays, so the sizes are chosen jointly.

Documents are dealt to groups of bounded size by a hash, so groups pack in parallel
and a group leaves at most a few bins underfilled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, in tokens.
SEQUENCE_COST = 16
ROWS_PER_GROUP = 4096
#: Copies of a row that are written out at a time. Bounds memory only.
COPIES = 65_536


class _OpenBins:
    """Bins by the room they have left; the fullest that still fits comes first."""

    def __init__(self):
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some bin has room r

    def put(self, room: int, bin_: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(bin_)
            self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fits = self.rooms >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bins = self.by_room[room]
        bin_ = bins.pop()
        if not bins:
            self.rooms &= ~(1 << room)
        return room, bin_


def _plan(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """The bin of each run (sizes descending, at most the largest capacity) and the bins' final sizes."""
    open_, filled, opened, where = _OpenBins(), [], [], []
    left = sum(sizes)
    for size in sizes:
        left -= size
        found = open_.take(size)
        if found is None:
            room = min((c for c in capacities if c >= size), key=lambda c: ((c + SEQUENCE_COST) / min(c, size + left), c))
            found = room, len(filled)
            filled.append(0)
            opened.append(room)
        room, bin_ = found
        filled[bin_] += size
        where.append(bin_)
        open_.put(room - size, bin_)
    return where, [min(c for c in capacities if c >= n) for n in filled]


def best_plan(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """The cheapest of the plans that open bins up to one of the permitted sizes (descending sizes)."""
    plans = []
    ordered = sorted(set(capacities))
    for k, top in enumerate(ordered):
        if not sizes or top >= sizes[0]:
            where, final = _plan(sizes, ordered[: k + 1])
            plans.append((sum(final) + SEQUENCE_COST * len(final), k, where, final))
    _, _, where, final = min(plans)
    return where, final


def pack_group(ids: list, lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple]:
    """(id, piece, start, tokens, bin, capacity, place): every token of every document once."""
    most = max(capacities)
    runs = []
    for k, n in enumerate(lengths):
        runs += [(-min(most, n - at), k, at) for at in range(0, n, most)]
    runs.sort()
    where, final = best_plan([-r[0] for r in runs], capacities)
    filled = [0] * len(final)
    out = []
    for (size, k, at), bin_ in zip(runs, where, strict=True):
        out.append((ids[k], at // most, at, -size, bin_, final[bin_], filled[bin_]))
        filled[bin_] -= size
    return out


def pack(rows: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", length_col: str = "n_tokens", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Rows id, piece, start, tokens, group, bin, capacity, place.

    Documents longer than the largest capacity are cut into pieces of that size and a
    rest; no token is dropped. bin counts from 0 within group, and place is where
    the piece starts in its bin. A null or negative length counts as 0, and documents of
    length 0 take no bin and give no row. Rows with equal ids are packed one by one; rows equal
    in id and length are counted first and dealt to the groups in turn, so that a third of all rows
    may be such copies. The result depends on the rows only, not on their order or partitions.
    """
    n = rows.count()
    groups = max(1, -(-n // rows_per_group))
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n")
    narrow = rows.select(F.col(id_col).alias("id"), length)
    copies = narrow.groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies"))
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) DIV {COPIES}"))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1)))
    narrow = copies.select("id", "n", F.pmod(F.pmod(F.xxhash64("id", "n"), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("group"))
    names = ["piece", "start", "tokens", "group", "bin", "capacity", "place"]
    schema = T.StructType([narrow.schema["id"], *(T.StructField(x, T.LongType()) for x in names)])

    def packed(key: tuple, frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([("n", "descending"), ("id", "ascending")])
        out = pack_group(frame["id"].to_pylist(), frame["n"].to_pylist(), capacities)
        cells = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
        ints = [pa.array(c, pa.int64()) for c in cells[1:]]
        group = pa.array([key[0].as_py()] * len(out), pa.int64())
        return pa.Table.from_arrays([pa.array(cells[0], frame.schema.field("id").type), *ints[:3], group, *ints[3:]], names=["id", *names])

    return narrow.groupBy("group").applyInArrow(packed, schema)


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_tokens: words (runs without ASCII white space) of the whole text, and one end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x.as_py().encode().split()) + 1 if x.is_valid else 1 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(count), T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType())]))
