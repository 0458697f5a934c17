"""The Merkle manifest, the prefix trie and line de-duplication against brute-force versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.llm import prefix_trie as trie_module
from rankwell.llm.line_dedup import keep_bitmaps, packed, unpacked, without_repeats
from rankwell.llm.merkle import audited, folded, siblings_digest
from rankwell.llm.ordering import numbered
from rankwell.llm.prefix_trie import prefix_trie


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture
def many_runs(spark, monkeypatch):
    """So many partitions that groups lie in several runs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- places in groups


def test_places_of_groups_over_several_runs(spark, many_runs):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", "", "d"]), rng.choice([None, *range(900)]), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "g string, x long, i long").repartition(5), "g", ["x", "i"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r.g, r.x, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)] == own
        assert sorted(r.pos for r in got if r.g == g) == list(range(len(own)))


def test_places_of_nothing(spark):
    assert numbered(spark.createDataFrame([], "g string, x long"), "g", ["x"]).count() == 0


# --- op11 Merkle manifest


def record(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest_by_hand(rows):
    """(leaf, subroot, root, proof, folded root) per row of doc_id, source, lang, n_chars, text."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, record(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h, siblings = record((*r[:4], lowered(r[4]))) if bad else leaf, ""
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run, j = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    siblings += "".join(run[:j] + run[j + 1 :])
                    h, at = H("".join([*run[:j], h, *run[j + 1 :]])), at // 16
            out.append((leaf, trees[s][-1][0], top[-1][0], H(siblings), h))
    return sorted(out)


def manifest(df):
    rows = audited(df)
    return sorted(map(tuple, rows.select("leaf", "subroot", "root", siblings_digest(F.col("path")), folded(F.col("forged"), F.col("path"))).collect()))


@pytest.mark.parametrize("sources", [["hot"] * 9 + ["a", None, ""], [None], [f"s{i}" for i in range(300)]])
def test_manifest_by_hand(spark, many_runs, sources):
    rng = random.Random(11)
    rows = [(i if rng.random() < 0.97 else None, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", f"Text {i}", "ÀB\n", "x"])) for i in range(700)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(c) for c in ("g", "pos", "digest", "entry", "run")})
    assert manifest(df) == manifest_by_hand(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", None, 1, "T") for i in range(n)]
    assert manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == manifest_by_hand(rows)


# --- op12 prefix trie


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(x, key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2][0].encode())}:{t[2][0]}{t[2][1]}".encode()).digest()[:16]))] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [out[q] for q in out if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), H(ends))
    return sorted(out.values(), key=repr)


def trie(df, **how):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in prefix_trie(df, **how).collect()), key=repr)


CONVS = "conv_id long, turn long, role string, text string"


def conversations(rng, n):
    """Copies, shared beginnings, a hot first turn, absent bases, nulls and conversations that stop early."""
    rows = []
    for c in range(n):
        if c % 100 == 0 and rng.random() < 0.4:
            continue
        length = rng.choice([1, 2, 3, 4, 9])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["u", None]) if rng.random() < 0.1 else "u", rng.choice([None, "", "é"]) if rng.random() < 0.1 else f"hot {t}" if rng.random() < 0.7 else f"w{rng.randrange(3)}") for t in range(length)]
    return rows


@pytest.mark.parametrize("how", [{}, {"piece": 4, "most": 3, "bucket": 5}, {"piece": 100, "most": 1, "bucket": 1}])
def test_trie_by_hand(spark, many_runs, how):
    rows = [*conversations(random.Random(2), 230), (None, 0, "u", "nobody's")]
    df = spark.createDataFrame(rows, CONVS).withColumns({c: F.lit(1) for c in ("label", "n", "seq")})
    assert trie(df, **how) == trie_by_hand(rows)


def test_trie_of_copies_and_of_one_long_conversation(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(300, 360) for t in range(7)] + [(1, t, "u", "a") for t in range(40)]
    assert trie(spark.createDataFrame(rows, CONVS), piece=4, most=8) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], CONVS)) == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], CONVS)) == []


def test_chunks_of_ids_are_hashed_as_one(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "CHUNK_IDS", 3)
    rows = [(c, 0, "u", "same") for c in range(1000, 1100)]
    assert trie(spark.createDataFrame(rows, CONVS)) == trie_by_hand(rows)


# --- op13 lines


def lines_by_hand(rows):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, text in rows:
        at = (i is not None, i or 0)
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), at), at)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (i is not None, i or 0)]
        out.append((i, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines(df, **how):
    return sorted(((r.row.doc_id, r.row.text, r.lines, r.dropped, r.kept_text) for r in without_repeats(df, **how).collect()), key=repr)


def texts(rng, n):
    hot, pool = "A line that every text has", [" Shared line %d\t" % i for i in range(12)] + ["short", "", "   ", "0123456789", "É" * 10, "é" * 10, "123456789 "]
    return [(i if rng.random() < 0.97 else None, rng.choice([None, "", "\n\n"]) if rng.random() < 0.05 else "\n".join([hot] * (rng.random() < 0.6) + [rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(9))] + [f"only here {i}"])) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}])
def test_lines_by_hand(spark, many_runs, how):
    rows = texts(random.Random(4), 400)
    rows += [rows[5], (7, "another text of 7\nA line that every text has")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "copy", "h1", "row", "lines", "place")})
    assert lines(df, **how) == lines_by_hand(rows)


def test_lines_of_nothing_and_of_long_texts(spark):
    schema = "doc_id long, text string"
    assert lines(spark.createDataFrame([], schema)) == []
    rows = [(2, "\n".join(f"a long line no {i % 700}" for i in range(50_000))), (1, "a long line no 3\n" * 3), (3, "x" * 200_000), (4, " " + "X" * 200_000)]
    assert lines(spark.createDataFrame(rows, schema)) == lines_by_hand(rows)


def test_one_line_over_many_runs(spark, many_runs):
    rows = [(i, "the one and only line") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines(df) == lines_by_hand(rows)
    assert keep_bitmaps(df).count() == 499


def test_bitmaps_round_trip_and_are_compressed():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 5000):
        keep = rng.random(n) < 0.5
        assert (unpacked(packed(keep), n) == keep).all()
    assert len(packed(np.ones(80_000, bool))) < 100
