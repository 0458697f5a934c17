"""Prefix tries of conversations, with totals over subtrees.

Conversations become sequences of 128-bit turn digests; equal ones are counted and go on
as one. Sequences are cut into segments of ``PIECE`` turns. A segment's label is the
signature of all turns before it, so segments under one node share a label and those of
all depths are grouped at once. Segments are grouped by label and first digest. Where a
group holds more than ``MOST`` turns, it is recursively repartitioned: the turns that
all of its segments begin with become one segment, and what follows is grouped by its
next turn. So neither a first turn that a third of all conversations share, nor a very
long conversation, is ever gathered in one task.

Groups are hashed into buckets; inside ``applyInPandas`` each bucket's tries are nodes of
pointer dictionaries, summed up in an iterative postorder. A generation of segments is
worked through after those that hang below it, whose totals it adds at its last nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_hash, stored, told_by_group
from .ordering import changes, numbered

#: Turns of a segment at most.
PIECE = 4096
#: Turns in a group of several segments before it is divided.
MOST = 2048
#: Turns that a bucket of small groups holds on average.
BUCKET = 512
#: Ids whose text is handed on as one chunk.
CHUNK_IDS = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long, label string"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; null counts as empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _marks(pos: Column, digest: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place; the bitwise sums of a prefix's are its signature."""
    return F.xxhash64(pos.cast("long"), digest), F.xxhash64(F.lit("turn"), pos.cast("long"), digest)


def _label(start: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", start.cast("string"), F.hex(a), F.hex(b))


def rebuilt(conversations: DataFrame, block: int = 100, most_heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, pos, digest, size) of the rebuilt conversations, and all ids (conv).

    Turns are ordered by ``turn``, null first, equal ones by digest. Conversation c begins with the
    first h turns of conversation c - c % block (all if it has fewer, none if there is none) and goes on with
    its own after its first h; h is crc32(c as text) % most_heads. Rows without conv_id belong to
    no conversation and are left out.
    """
    own = conversations.where("conv_id IS NOT NULL")
    digest = turn_digest(F.col("role"), F.col("text")).alias("digest")
    turns = stored(own.select(F.col("conv_id").cast("long").alias("conv"), "turn", digest, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")), "turns")
    turns = stored(numbered(turns, "conv", ["turn", "digest"]).select("conv", "pos", "digest", "size"), "placed")
    h = F.pmod(id_hash(F.col("conv")), F.lit(most_heads)).alias("h")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("held"))
    convs = stored(convs.select("conv", "held", h, (F.col("conv") - F.col("conv") % block).alias("base")), "convs")
    # h is below most_heads, so a base hands a few turns on to the ids of its block only
    lent = turns.where(F.col("pos") < most_heads - 1).withColumnRenamed("conv", "base")
    first = convs.select("conv", "base", "h").join(lent, "base").where("pos < h").select("conv", "pos", "digest", "size")
    bases = convs.select(F.col("conv").alias("base"), F.col("held").alias("has"))
    begun = stored(convs.join(bases, "base", "left").select("conv", "held", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent")), "begun")
    rest = told_by_group(turns, begun, ["conv"], "held", turns.count()).where("pos >= h")
    rest = rest.select("conv", (F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), "digest", "size")
    return first.unionByName(rest), convs.select("conv")


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation's distinct sequence (conv, seq), and every sequence: seq, n, length.

    A sequence is named after the smallest conversation that has it and recognised by its length and
    128 bits of signature, which are aggregated without ordering or collecting turns.
    """
    a, b = _marks(F.col("pos"), F.col("digest"))
    signed = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))
    signed = stored(convs.join(signed, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("length", "a", "b"))), "signed")
    seqs = stored(signed.groupBy("length", "a", "b").agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("n")), "seqs")
    return told_by_group(signed, seqs, ["length", "a", "b"], "n", signed.count()).select("conv", "seq"), seqs.select("seq", "n", "length")


def pieces(turns: DataFrame, seqs: DataFrame, size: int) -> DataFrame:
    """Segments of at most ``size`` turns of every sequence.

    piece, label (of what comes before), signed (its two signatures), start, turns (digest, size), n, rep,
    end_seq (the sequence that ends here) or next (the label of what follows).
    """
    known = seqs.withColumnRenamed("seq", "conv")
    rows = told_by_group(turns, known, ["conv"], "length", turns.count()).withColumn("piece", F.expr(f"pos DIV {size}"))
    a, b = _marks(F.col("pos"), F.col("digest"))
    held = F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("held")
    rows = rows.groupBy("conv", "piece").agg(held, F.max("n").alias("n"), F.max("length").alias("length"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}0") for x in "ab"))
    start = F.col("piece") * size
    ends = start + size >= F.col("length")
    below = _label(start + size, F.col("a0").bitwiseXOR(F.col("a")), F.col("b0").bitwiseXOR(F.col("b")))
    turns_ = F.transform("held", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns")
    label = _label(start, F.col("a0"), F.col("b0")).alias("label")
    return rows.select("piece", label, F.struct("a0", "b0").alias("signed"), start.alias("start"), turns_, "n", F.col("conv").alias("rep"), F.when(ends, F.col("conv")).alias("end_seq"), F.when(~ends, below).alias("next"))


def _common(lo: Column, hi: Column) -> Column:
    """How many turns the least and the greatest array begin with alike; so do all between them."""
    n = F.least(F.size(lo), F.size(hi))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(lo, i) != F.element_at(hi, i))
    at = F.array_position(differs, True).cast("int")
    return F.when(at == 0, n).otherwise(at - 1)


def _merged(segments: DataFrame) -> DataFrame:
    """Equal segments under one label as one, with all their conversations."""
    keys = ["piece", "label", "signed", "start", "turns"]
    return segments.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("rep").alias("rep"), F.max("end_seq").alias("end_seq"), F.max("next").alias("next"))


def divided(segments: DataFrame, most: int) -> list[DataFrame]:
    """Generations of merged segments; each hangs below those before it.

    While a group (label, first digest) of several segments holds over ``most`` turns, the turns
    that all of them begin with are cut off as one segment, and the rest is grouped by its next turn.
    """
    out, rest = [], segments
    while True:
        merged = stored(_merged(rest), "segments")
        first = F.col("turns")[0]["digest"].alias("first")
        digests = F.col("turns.digest")
        groups = merged.groupBy("label", first).agg(F.count(F.lit(1)).alias("held"), F.sum(F.size("turns")).alias("weight"), F.min(digests).alias("lo"), F.max(digests).alias("hi"))
        large = stored(groups.where((F.col("weight") > most) & (F.col("held") > 1)).select("label", "first", _common(F.col("lo"), F.col("hi")).alias("cut")), "large")
        if large.isEmpty():
            return [*out, merged]
        cut = merged.withColumn("first", first).join(large, ["label", "first"], "left").withColumn("cut", F.coalesce("cut", F.size("turns")))
        start, longer = F.col("start") + F.col("cut"), F.size("turns") > F.col("cut")

        def mark(i: int, zero: str) -> Column:
            begin = F.slice("turns", F.lit(1), F.col("cut"))
            marks = F.transform(begin, lambda t, j: _marks(F.col("start") + j, t["digest"])[i])
            return F.aggregate(marks, F.col("signed")[zero], lambda s, x: s.bitwiseXOR(x)).alias(zero)

        cut = stored(cut.withColumn("below", F.when(longer, F.struct(mark(0, "a0"), mark(1, "b0")))), "cut")
        label = _label(start, F.col("below.a0"), F.col("below.b0"))
        begin = cut.withColumn("turns", F.slice("turns", F.lit(1), F.col("cut"))).withColumn("end_seq", F.when(F.col("below").isNull(), F.col("end_seq"))).withColumn("next", F.when(F.col("below").isNotNull(), label).otherwise(F.col("next")))
        out.append(stored(_merged(begin), "begun"))
        after = F.slice("turns", F.col("cut") + 1, F.size("turns"))
        rest = cut.where("below IS NOT NULL").select("piece", label.alias("label"), F.col("below").alias("signed"), start.alias("start"), after.alias("turns"), "n", "rep", "end_seq", "next")


def summed(rows: Iterator[tuple]) -> list[tuple]:
    """The nodes (columns of NODE) of the tries that segments make up.

    A segment: label, start, digests, sizes, n, rep, end_seq, parent (the conversation of the node it
    hangs from), below (leaves, tokens and children of what hangs from its end; all 0 if nothing does).
    """
    tops: dict[str, dict[bytes, int]] = {}
    kids: list[dict[bytes, int]] = []
    nodes: list[list] = []
    for label, start, digests, sizes, n, rep, end_seq, parent, leaves, saved, children in rows:
        level, at, up = tops.setdefault(label, {}), -1, parent
        for i, digest in enumerate(digests):
            at = level.get(digest, -1)
            if at < 0:
                level[digest] = at = len(nodes)
                kids.append({})
                # rep, depth, parent, n, size, end, label, and what is below
                nodes.append([rep, start + i + 1, up, 0, sizes[i], None, label if i == 0 else None, 0, 0, 0])
            node = nodes[at]
            node[0], node[3] = min(node[0], rep), node[3] + n
            level, up = kids[at], at
        if end_seq is not None:
            nodes[at][5] = end_seq
        if children:
            nodes[at][7:] = [leaves, saved, children]
    out = []
    for top in tops.values():
        stack = [(at, False) for at in top.values()]
        while stack:
            at, done = stack.pop()
            node = nodes[at]
            if not done:
                stack.append((at, True))
                stack += [(kid, False) for kid in kids[at].values()]
                continue
            for kid in kids[at].values():
                node[7] += nodes[kid][7]
                node[8] += nodes[kid][8]
            node[9] += len(kids[at])
            node[7] = node[7] or 1
            node[8] += (node[3] - 1) * node[4]
            up = node[2] if node[6] is not None else nodes[node[2]][0]
            out.append((node[0], node[1], up, node[3], node[9], node[7], node[8], node[5], node[6]))
    return out


SEGMENT = ["label", "start", "digests", "sizes", "n", "rep", "end_seq", "parent", "leaves", "saved", "children"]


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    none = lambda x: None if x is None or x != x else int(x)
    columns = [pdf[c] for c in SEGMENT]
    columns[6] = map(none, columns[6])
    names = [c.split()[0] for c in NODE.split(", ")]
    out = pd.DataFrame(summed(zip(*columns, strict=True)), columns=names)
    return out.astype({c: "Int64" for c in names[:-1]})


def _told(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Left join that doesn't move rows whose key is null."""
    added = [F.lit(None).cast(others.schema[c].dataType).alias(c) for c in others.columns if c != key]
    return rows.where(F.col(key).isNotNull()).join(others, key, "left").unionByName(rows.where(F.col(key).isNull()).select("*", *added))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (seq, conv): seq, from, ids (comma-joined)."""
    last, held, seq = None, [], None

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int64()), "from": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})

    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes([batch.column(0)], last).tolist()
        for s, c, fresh in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), new, strict=True):
            if held and (fresh or len(held) >= CHUNK_IDS):
                yield chunk()
                held = []
            seq = s
            held.append(c)
        last = [batch.column(0).slice(batch.num_rows - 1)]
    if held:
        yield chunk()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (seq, from, ids): seq and the SHA-256 of its chunks, read as a stream."""
    seq = state = None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"end_seq": pa.array([seq], pa.int64()), "ends": [state.hexdigest()]})

    for batch in batches:
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if s != seq or state is None:
                if state is not None:
                    yield told()
                seq, state = s, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield told()


def ends_digests(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """end_seq, ends: SHA-256 of the comma-joined, ascending ids of the conversations with a sequence.

    Ids are sorted in ranges and packed; the chunks of one sequence are hashed as a stream in one task, which
    the digest's definition asks for, with one chunk in memory.
    """
    alone = seqs.where("n = 1").select(F.col("seq").alias("end_seq"), F.sha2(F.col("seq").cast("string"), 256).alias("ends"))
    many = stored(members.join(seqs.where("n > 1").select("seq"), "seq", "left_semi").select("seq", "conv"), "members")
    packed = many.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_chunks, "seq long, from long, ids string")
    return alone.unionByName(packed.repartition("seq").sortWithinPartitions("seq", "from").mapInArrow(_hashed, "end_seq long, ends string"))


def prefix_trie(conversations: DataFrame, piece: int = PIECE, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see :func:`rebuilt`), the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Null roles and texts count as empty. An empty table has no root. Other columns are ignored.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    turns = stored(turns, "rebuilt")
    members, seqs = sequences(turns, convs)
    members = stored(members, "members")
    generations = divided(stored(pieces(turns, seqs, piece), "pieces"), most)
    begin = seqs.agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("seq"))).alias("end_seq"), F.max("length").alias("longest"))
    first = begin.first()
    root = _label(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    uppers = generations[0].where("next IS NOT NULL").select(F.col("next").alias("label"), F.col("rep").alias("parent"))
    for more in generations[1:]:
        uppers = uppers.unionByName(more.where("next IS NOT NULL").select(F.col("next").alias("label"), F.col("rep").alias("parent")))
    uppers = stored(uppers, "uppers")
    below = spark.createDataFrame([], "next string, leaves long, saved long, children long")
    nodes = []
    for layer in range(-(-(first["longest"] or 0) // piece) - 1, -1, -1):
        for generation in reversed(generations):
            own = generation.where(F.col("piece") == layer)
            weight = own.agg(F.sum(F.size("turns"))).first()[0]
            if not weight:
                continue
            # most segments hang from the root, which needs no join
            told = _told(own, below, "next")
            top = told.where(F.col("label") == root).withColumn("parent", F.lit(first["conv_id"]).cast("long"))
            told = top.unionByName(told.where(F.col("label") != root).join(uppers, "label"), allowMissingColumns=False)
            at = F.pmod(F.xxhash64("label", F.col("turns")[0]["digest"]), F.lit(weight // bucket + 1)).alias("bucket")
            split = [F.col(f"turns.{x}").alias(f"{x}s") for x in ("digest", "size")]
            zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "saved", "children")]
            made = told.select(at, "label", "start", *split, "n", "rep", "end_seq", "parent", *zero).groupBy("bucket").applyInPandas(_bucket, NODE)
            made = stored(made, "nodes")
            nodes.append(made)
            tops = made.where("label IS NOT NULL").groupBy(F.col("label").alias("next"))
            found = tops.agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"))
            below = stored(below.unionByName(found), "below")
    under = below.where(F.col("next") == root).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children")).first()
    top = begin.where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(under["children"] or 0).cast("long").alias("n_children"), F.lit(under["leaves"] or 1).cast("long").alias("n_leaves"), F.lit(under["saved"] or 0).cast("long").alias("saved_tokens"), "end_seq")
    for made in nodes:
        top = top.unionByName(made.drop("label"))
    rows = _told(top, ends_digests(members, seqs), "end_seq")
    return rows.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).drop("ends", "end_seq")
