"""Every training-data operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import random
import zlib
from itertools import product
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankwell.llm import decontamination, hmm, language_id, license_scan, ngram_join, packing, queries, token_counts, token_files
from rankwell.llm import components as components_module
from rankwell.llm.components import components
from rankwell.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from rankwell.llm.sharding import interleaved

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id int, digest int, bucket int, node int, block int, words int"
#: Null ids, texts, languages and sources; empty, blank and odd texts; equal rows; copies but for case.
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (None, "no id here at all", "en", "a"), (None, "no id here at all", "en", "a"),
    (4, "Equal Text one two three", "en", "b"), (5, "equal text one two three", "de", "b"), (5, "equal text one two three", "de", "b"), (6, "ÉTÉ x", "fr", "b"), (7, "été x", "fr", None),
    (8, "a", "en", "a"), (9, "123 456 !!", "en", "a"), (10, "  x\x1cy  z\r\n", "es", "a"), (11, "<|endoftext|> hi<|endoftext|>", "en", "a"), (12, "😀 \U00010400 ok", "en", "a"), (13, "long " * 30000, "en", "a"), (14, "x" * 20000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, "r", 1, 2, 3, 4, 5, 6) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture
def odd_dir(odd, empty, spark, tmp_path):
    """Folders with odd and with empty documents, and a benchmark."""
    for name, df in (("odd", odd), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "no id here at all"), (4, "été"), (5, "no id here at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        turns = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "user", "x"), (100, 0, "user", "long " * 30000), (100, None, "user", "😀")] if name == "odd" else []
        spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("label", "seq", "conv", "n", "pos")}).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return tmp_path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_and_odd_rows(spark, odd_dir, name):
    assert queries.QUERIES[name](spark, f"{odd_dir}/empty").count() == 0
    rows = queries.QUERIES[name](spark, f"{odd_dir}/odd").collect()
    if name == "op1_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(None, 3), (None, 5), (6, 4), (7, 4)} - {(6, 4)}
    elif name == "op12_prefix_trie":
        assert sorted((r.conv_id, r.depth, r.n_convs) for r in rows)[0] == (1, 0, 2)
    elif name != "op2_packing":
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ODD)


# --- op9 exact de-duplication


def lowered(t):
    return (t or "").encode().lower()


def test_exact_duplicates_of_odd_rows(odd):
    got = exact_duplicates(odd).collect()
    groups = collections.defaultdict(list)
    for r in ODD:
        groups[hashlib.sha256(lowered(r[1])).hexdigest()].append(r[0])
    assert len(got) == len(ODD)
    for r in got:
        own = groups[r.digest]
        known = [x for x in own if x is not None]
        assert r.group_size == len(own) and r.keep_id == (max(known) if known else None)
    kept = collections.Counter(r.digest for r in got if r.kept)
    assert kept == {d: 1 for d in groups}


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_survivors_keep_all_columns(odd, broadcast_bytes):
    out = drop_exact_duplicates(odd, broadcast_bytes=broadcast_bytes)
    assert out.columns == odd.columns
    assert sorted(lowered(r.text) for r in out.collect()) == sorted({lowered(r[1]) for r in ODD})


# --- op7 sharding


def test_shards_match_the_mixture(spark):
    rng = random.Random(3)
    rows = [(i, "t" * rng.randrange(9), rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(3000)]
    got = interleaved(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=7).collect()
    assert len(got) == 3000
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    whole = collections.Counter(r.source for r in got)
    for own in by.values():
        part = collections.Counter(r.source for r in own)
        assert all(abs(part[s] - n / 7) <= 2 for s, n in whole.items())
    assert {r.id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t.encode())) for i, t, _ in rows}


def test_small_sources_are_spread(spark):
    rows = [(i, "t", f"s{i}") for i in range(4000)] + [(4000 + i, "t", "hot") for i in range(4000)]
    got = interleaved(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=8).collect()
    small = collections.Counter(r.shard for r in got if r.source != "hot")
    hot = collections.Counter(r.shard for r in got if r.source == "hot")
    assert all(400 < small[k] < 600 and 400 < hot[k] < 600 and small[k] + hot[k] == 1000 for k in range(8))


# --- op4 token counts and op8 token files


def whole_counts(path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in rows]


def test_token_counts_are_the_librarys(odd, docs, texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()}
    ids = list(texts)
    assert got == {i: (len(texts[i].encode()), len(n)) for i, n in zip(ids, whole_counts(path, [texts[i] for i in ids]), strict=True)}
    got = collections.Counter((r.id, r.n_tokens) for r in token_counts.token_counts(odd, path).collect())
    assert got == collections.Counter((r[0], len(n)) for r, n in zip(ODD, whole_counts(path, [r[1] for r in ODD]), strict=True))


def test_safe_pieces_join_to_the_text_and_count_alike():
    rng = random.Random(5)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    lengths = token_counts.PieceLengths(path)
    made = ["".join(rng.choice(["ab", " ", "\n", "'s", "é", "\t", " ", ".", "1", "<|endoftext|>", "\x1c", "😀"]) for _ in range(40)) for _ in range(400)]
    for t, ids in zip(made, whole_counts(path, made), strict=True):
        pieces = token_counts.safe_pieces(t)
        assert "".join(pieces) == t and sum(lengths(pieces)) == len(ids)


def test_batches_hold_about_equally_many_bytes():
    texts = ["é" * 100 + " a" * 50_000, "ab " * 300, "", None, "😀 " * 40_000]
    for apart in (True, False):
        sizes, joined = [], collections.defaultdict(str)
        for pieces, owners in token_counts.byte_batches(texts, 20_000, apart):
            sizes.append(sum(len(p.encode()) for p in pieces))
            for p, i in zip(pieces, owners, strict=True):
                joined[i] += p
        assert dict(joined) == {i: t for i, t in enumerate(texts) if t}
        largest = max(len(p.encode()) for t in texts for p in (token_counts.safe_pieces(t or "") if apart else [t or ""]))
        assert max(sizes) <= 20_000 + largest + 3 * 1024 and sum(sizes) == sum(len(t.encode()) for t in texts if t)


def test_other_tokenizers_are_given_whole_texts(spark, odd):
    import public_tokenizers

    path = queries.tokenizer_path("word_bpe_49k.json")
    assert token_counts.splits_at_spaces(queries.tokenizer_path("byte_bpe_50k.json")) and not token_counts.splits_at_spaces(path)
    got = collections.Counter((r.id, r.n_tokens) for r in token_counts.token_counts(odd, path).collect())
    assert got == collections.Counter((r[0], len(n)) for r, n in zip(ODD, whole_counts(path, [r[1] for r in ODD]), strict=True))
    models = sorted(p for p in __import__("pathlib").Path(public_tokenizers.__file__).parent.iterdir() if p.suffix == ".model")
    if models:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=str(models[0]))
        got = collections.Counter((r.id, r.n_tokens) for r in token_counts.token_counts(odd, str(models[0])).collect())
        assert got == collections.Counter((r[0], len(library.encode(r[1] or ""))) for r in ODD)


def test_token_files_round_trip(spark, odd, docs, texts):
    path = queries.tokenizer_path("word_bpe_49k.json")
    files = token_files.write_token_files(docs, path)
    got = {r.id: r for r in token_files.read_token_files(docs, files).collect()}
    at = 0
    order = sorted(texts)
    every = []
    for i, ids in zip(order, whole_counts(path, [texts[i] for i in order]), strict=True):
        ids = [*ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        every += ids
    flat = []
    for name, _, n in files:
        f = token_files.SequenceFile(name)
        own = []
        for i in range(len(f)):
            ids, mask = f[i]
            assert len(ids) == token_files.SEQUENCE
            own += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert len(own) == n
        flat += own
    assert flat == every
    files = token_files.write_token_files(odd, path)
    got = collections.Counter((r.id, r.ids_crc32) for r in token_files.read_token_files(odd, files).collect())
    assert got == collections.Counter((r[0], zlib.crc32(np.array([*n, 1], "<u4").tobytes())) for r, n in zip(ODD, whole_counts(path, [r[1] for r in ODD]), strict=True))


def test_other_tokenizers_encode_whole_texts(spark, odd, tmp_path):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    assert token_files.drops_white_space(queries.tokenizer_path("word_bpe_49k.json")) and not token_files.drops_white_space(path)
    files = token_files.write_token_files(odd, path, end_id=None)
    got = collections.Counter((r.id, r.ids_crc32) for r in token_files.read_token_files(odd, files).collect())
    assert got == collections.Counter((r[0], zlib.crc32(np.array(n, "<u4").tobytes())) for r, n in zip(ODD, whole_counts(path, [r[1] for r in ODD]), strict=True))


def test_views_of_a_token_file_are_not_copies(tmp_path):
    path = f"{tmp_path}/x.arrow"
    with pa.OSFile(path, "wb") as sink:
        out = token_files.SequenceWriter(sink, np.dtype("<u2"), sequence=4, sequences=2)
        out.add(np.arange(11, dtype="<u2").tobytes())
        out.close()
    f = token_files.SequenceFile(f"file://{path}", sequences=2)
    assert len(f) == 3
    for i, (n, want) in enumerate([(4, [0, 1, 2, 3]), (4, [4, 5, 6, 7]), (3, [8, 9, 10, 0])]):
        ids, mask = f[i]
        assert ids.tolist() == want and mask.to_pylist() == [k < n for k in range(4)]
        batch = f.file.get_batch(i // 2)
        assert not ids.flags.owndata and mask.buffers()[1].address == batch.column(1).values.buffers()[1].address


# --- op6 language identification


def test_windows_are_spread_over_the_text(spark):
    text = "".join(chr(97 + k % 26) * 100 for k in range(300))
    for most in (10, 300, 1000, 16_384, 40_000):
        got = language_id.spread(text, most)
        assert len(got) <= most and (most < 16_384 or text[-1] in got[-1])
        assert spark.createDataFrame([(text,)], "t string").select(language_id._spread(F.col("t"), most).alias("t")).first().t == got


def longest_phrases(text, sample):
    """Greedy phrases by search, as the automaton counts them."""
    n, at = 0, 0
    while at < len(text):
        k = at + 1
        while k < len(text) and text[at : k + 1] in sample:
            k += 1
        n, at = n + 1, k
    return n


def test_automaton_parses_like_a_search():
    rng = random.Random(1)
    sample = "".join(rng.choice("abcd ") for _ in range(300))
    parser = language_id.CrossParser({"x": sample, "y": sample[::-1]})
    texts_ = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    for k, s in enumerate((sample, sample[::-1])):
        for t in texts_:
            symbols = parser.symbol[language_id._points(t)]
            got = parser._phrases(symbols, np.array([0]), np.array([len(t)]))
            assert got[k, 0] == longest_phrases(t, s)


def test_languages_of_many_letters_are_told_apart():
    rng = random.Random(3)
    letters = {"aa": "abcdefghijklmnopqrstuvwxyz", **{x: [chr(at + k) for k in range(300)] for x, at in (("bb", 0x4E00), ("cc", 0x5E00), ("dd", 0x20000))}}
    words = {x: ["".join(rng.choice(c) for _ in range(3)) for _ in range(400)] for x, c in letters.items()}
    text = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    samples = {x: text(x, 600) for x in letters}
    parser = language_id.CrossParser(samples)
    asked = [x for x in letters for _ in range(5)]
    texts_ = [text(x, 30) for x in asked]
    assert parser(texts_)[0] == asked
    for x in parser.languages:
        t = samples[x][::-1][:300]
        symbols = parser._lettered(language_id._points(t))[1]
        got = parser._phrases(symbols, np.array([0]), np.array([len(t)]))
        assert got[parser.languages.index(x), 0] == longest_phrases(t, samples[x])


def test_language_accuracy_on_held_out_documents(spark):
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    right = [r.lang_pred == lang[r.doc_id] for r in rows]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_undetermined_texts(odd):
    got = {r.row.doc_id: r for r in language_id.identify_languages(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[12].lang_pred != "und"
    assert {r.doc_id for r in language_id.keep_identified(odd).collect()} == {None, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14}


# --- op3 language model


@pytest.mark.parametrize("run", [1, 2, 512])
def test_forward_is_the_sum_over_all_paths(monkeypatch, run):
    monkeypatch.setattr(hmm, "RUN", run)
    rng = np.random.RandomState(0)
    m = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    for n in (1, 2, 5):
        ids = rng.randint(0, 5, n).astype(np.uint16)
        total = 0.0
        for path in product(range(3), repeat=n):
            p = m.start[path[0]] * m.emit[ids[0], path[0]]
            for t in range(1, n):
                p *= m.move[path[t - 1], path[t]] * m.emit[ids[t], path[t]]
            total += p
        assert np.isclose(hmm.forward_log10(m, ids, np.array([n]))[0], log10(total))


@pytest.mark.parametrize(("run", "batch"), [(512, 1 << 19), (1, 2), (2, 3), (3, 100)])
def test_expected_counts_are_the_posteriors_and_raise_the_likelihood(monkeypatch, run, batch):
    monkeypatch.setattr(hmm, "RUN", run)
    monkeypatch.setattr(hmm, "BATCH_TOKENS", batch)
    rng = np.random.RandomState(1)
    m = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    sizes = np.array([3, 1, 4])
    ids = rng.randint(0, 4, sizes.sum()).astype(np.uint16)
    start, moves, emission = hmm.expected_counts(m, ids, sizes)
    assert np.isclose(start.sum(), 3) and np.isclose(moves.sum(), 5) and np.isclose(emission.sum(), 8)
    want, at = np.zeros((2, 2)), 0
    for n in sizes:
        own = ids[at : at + n]
        paths = {}
        for path in product(range(2), repeat=int(n)):
            p = m.start[path[0]] * m.emit[own[0], path[0]]
            for t in range(1, n):
                p *= m.move[path[t - 1], path[t]] * m.emit[own[t], path[t]]
            paths[path] = p
        z = sum(paths.values())
        for path, p in paths.items():
            for t in range(1, n):
                want[path[t - 1], path[t]] += p / z
        at += n
    assert np.allclose(moves, want)
    better = hmm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emission / emission.sum(0))
    assert hmm.forward_log10(better, ids, sizes).sum() >= hmm.forward_log10(m, ids, sizes).sum()


def test_language_model_scores(spark, texts):
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, SF).collect()}
    words = {i: hmm.words_of(t) for i, t in texts.items()}
    trains = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in trains for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert r.held_out == (i not in trains) and r.train_tokens == n and r.n_tokens == len(words[i])
        assert r.n_known == sum(c[w] > 0 for w in words[i])
        assert np.isclose(r.base_score, sum(log10((c[w] + 1) / (n + v + 1)) for w in words[i]), rtol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)



def test_scores_by_hand(spark, monkeypatch):
    """Scores from the trained states and the words' own counts, a token at a time."""
    rng = random.Random(8)
    for name, value in (("HEAVY", 64), ("OWN", 24)):
        monkeypatch.setattr(hmm, name, value)
    kept = {}
    train = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a: kept.setdefault("model", train(*a)))
    learn = hmm.learn_classes
    monkeypatch.setattr(hmm, "learn_classes", lambda c: kept.setdefault("classes", learn(c)))
    vocab = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for k in range(30)] + [(30, None), (31, "never seen words"), (32, " ".join(vocab * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in hmm.language_model_scores(docs, F.col("doc_id") % 4 != 0, states=3, rounds=2).collect()}
    model, classes = kept["model"], kept["classes"]
    counts = collections.Counter(w for k, t in rows if k % 4 for w in hmm.words_of(t))
    members = collections.defaultdict(list)
    for w in counts:
        members[classes.class_of(w)].append(w)

    def share(word):
        k = classes.class_of(word)
        if k < classes.own:
            return 1.0
        return (counts[word] + 1) / (sum(counts[w] for w in members[k]) + len(members[k]) + 1)

    for k, own in members.items():
        unknown = 0 if k < classes.own else share(next(w for w in (b"no%d" % j for j in range(999)) if classes.class_of(w) == k))
        assert np.isclose(sum(map(share, own)) + unknown, 1)
    assert len(members) > classes.own > 2
    for k, text in rows:
        expected, log = model.start, 0.0
        for w in hmm.words_of(text):
            here = expected * model.emit[classes.class_of(w)] * share(w)
            log += log10(here.sum())
            expected = here / here.sum() @ model.move
        assert np.isclose(got[k].score, log, rtol=1e-9)


# --- op1 decontamination


def test_finds_edited_items_and_leaves_others():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 40)))) for k in range(20)]
    finder = decontamination.PassageFinder(items)
    for key, item in items:
        n = len(item)
        for edits in (0, n // 25, n // 12):
            t = list(item)
            for _ in range(edits):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["q"], [t[at], "z"]])
            body = " ".join(rng.choice(vocab) for _ in range(50)) + ". " + "".join(t).upper() + "! " + " ".join(rng.choice(vocab) for _ in range(50))
            found = {f[0] for f in finder.find(np.frombuffer(body.encode(), np.uint8))}
            assert found == {key}
        assert not finder.find(np.frombuffer(" ".join(rng.choice(vocab) for _ in range(300)).encode(), np.uint8))


def test_banded_distance_is_edit_distance():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        got = decontamination.banded_distance(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), -len(a), len(a) + len(b) + 1)
        assert got[0] == min(row)


def test_passages_cover_exact_search(spark, texts):
    flat = lambda t: b" " + decontamination.normal_form(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip() + b" "
    items = {r.item_id: flat(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in flat(t)}
    rows = queries.op1_decontamination(spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        part = texts[r.doc_id].encode()[r.start : r.stop].decode(errors="replace")
        assert r.edits > 0 or flat(part).strip() == items[r.item_id]


@pytest.mark.parametrize("gone", [1, 3, 5])
def test_passages_belong_to_the_text_that_holds_them(spark, gone):
    item = "seven grey herons stood along the river bank until the evening boats came home again"
    texts = ["A clean text stands before it.", item[gone:] + " and so on.", "Another clean one.", "It ends with " + item[:-gone], item[-gone:] + " begins the next, clean one.", item[gone:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = decontamination.contaminated_passages(docs, benchmark).collect()
    assert {(r.id, r.edits) for r in rows} == {(1, gone), (3, gone), (5, gone)}
    assert all(0 <= r.start < r.stop <= len(texts[r.id]) for r in rows)
    assert {r.doc_id for r in decontamination.keep_uncontaminated(docs, benchmark).collect()} == {0, 2, 4}


def test_passages_do_not_depend_on_neighbours():
    rng = random.Random(6)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(12))) for k in range(10)]
    finder = decontamination.PassageFinder(items)
    texts = []
    for _ in range(200):
        item = rng.choice(items)[1]
        a, b = rng.choice([0, 0, 2, 4, 9]), rng.choice([0, 0, 2, 4, 9])
        texts += [rng.choice(["", "some words "]) + item[a : len(item) - b] + rng.choice(["", " other words"]), rng.choice(["", "clean", item[:a], item[len(item) - b :]])]
    alone = {(n, key, start, stop, edits) for n, t in enumerate(texts) for key, start, stop, edits in finder.find(np.frombuffer(t.encode(), np.uint8))}
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    together = set()
    for key, start, stop, edits in finder.find(np.frombuffer("\0".join(texts).encode(), np.uint8)):
        n = int(np.searchsorted(begins, start, side="right")) - 1
        together.add((n, key, start - int(begins[n]), stop - int(begins[n]), edits))
    assert {x[:2] for x in together} == {x[:2] for x in alone}
    assert all(0 <= start < stop <= len(texts[n]) for n, _, start, stop, _ in together)


def test_passages_of_long_texts_and_windows(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(15))) for k in range(20)]
    finder = decontamination.PassageFinder(items)
    body = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) for _ in range(41)]
    text = " ".join(x for k in range(20) for x in (body[k], items[k][1][:30] + items[k][1][32:], body[k + 20]))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = sorted(finder.find(data))
    assert {f[0] for f in whole} == set(range(20))
    monkeypatch.setattr(decontamination, "BATCH_BYTES", 64)
    assert sorted(finder.find(data)) == whole


@pytest.mark.parametrize("share", [0.1, 0.25])
def test_short_items_have_their_whole_budget(share):
    """Items of 8 to 60 characters in texts that begin, end or are cut off with them, against plain edit distance."""
    rng = random.Random(21)
    normal = lambda t: decontamination.normal_form(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip().decode()

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    items = [normal("".join(rng.choice("abcdef ") for _ in range(n + 12)))[:n].strip() + "x" for n in range(7, 60)]
    items = [(k, x) for k, x in enumerate(items) if len(x) >= 8]
    finder, hits = decontamination.PassageFinder(items, share), 0
    for key, item in items:
        for _ in range(12):
            t = list(item)
            for _ in range(rng.randrange(int(share * len(item)) + 2)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["q"], [t[at], "z"]])
            text = normal(rng.choice(["", "gg hh "]) + "".join(t)[rng.choice([0, 0, 1, 2]) :] + rng.choice(["", " ii jj"]))
            want = {(k, e) for k, x in items if (e := least(x, text)) <= int(share * len(x))}
            best = {}
            for k, _, _, e in finder.find(np.frombuffer(text.encode(), np.uint8)):
                best[k] = min(best.get(k, e), e)
            assert set(best.items()) == want, (item, text)
            hits += len(want)
    assert hits > 300


def test_short_items_of_the_verdict():
    finder = decontamination.PassageFinder([(1, "colour of the big door"), (2, "abcdefghij")])
    found = {(k, e) for k, _, _, e in finder.find(np.frombuffer(b"the color of the bg door, and abcdXfghij too", np.uint8))}
    assert found == {(1, 2), (2, 1)}


@pytest.mark.parametrize("parts", [1, 8])
def test_passages_against_edit_distance(spark, parts):
    """Texts that are shorter than their items at either end, several in a batch."""
    rng = random.Random(12)
    items = ["".join(rng.choice("abcdefg ") for _ in range(60)).strip().replace("  ", " x") for _ in range(4)]

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    texts = []
    for _ in range(60):
        item = rng.choice(items)
        a, b = rng.randrange(0, 8), rng.randrange(0, 8)
        texts.append(rng.choice([item[a : len(item) - b], item[: len(item) // 2], item[len(item) // 2 :], "zz " + item[a:], item[:-3] + " zz"]).strip())
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    finder = decontamination.PassageFinder(list(enumerate(items)))
    budget = dict(zip((k[0] for k in finder.keys), finder.budget.tolist(), strict=True))
    normal = lambda t: decontamination.normal_form(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip().decode()
    want = {(d, k, e) for d, t in enumerate(texts) for k, x in enumerate(items) if (e := least(normal(x), normal(t))) <= budget[k]}
    assert want
    assert {(r.id, r.item_id, r.edits) for r in decontamination.contaminated_passages(docs, benchmark).collect()} == want
    bad = {d for d, _, _ in want}
    assert {r.doc_id for r in decontamination.keep_uncontaminated(docs, benchmark).collect()} == set(range(len(texts))) - bad


# --- op2 packing


@pytest.mark.parametrize("lengths", [[], [0, None, -3], [1], [10, 10, 10, 5], [5000, 4096, 1, 700], [512] * 9 + [3] * 50])
def test_packing_holds_every_token_once(spark, lengths):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id bigint, n_tokens bigint")
    got = packing.pack(rows).collect()
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        total[r.id] += r.tokens
        bins[r.group, r.bin].append(r)
    assert total == {k: n for k, n in enumerate(lengths) if n and n > 0}
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.place):
            assert r.place == at
            at += r.tokens
        assert own[0].capacity == min(c for c in packing.CAPACITIES if c >= at)


def test_copies_of_a_row_are_dealt_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 50)
    rows = [(None, 300)] * 1000 + [(7, 40)] * 500 + [(i, 100 + i) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), rows_per_group=100).collect()
    assert collections.Counter((r.id, r.tokens) for r in got) == collections.Counter(rows)
    sizes = collections.Counter(r.group for r in got)
    assert len(sizes) == 18 and max(sizes.values()) < 140
    # what holds for distinct rows does not depend on copies of others
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.group, r.bin].append((r.place, r.tokens, r.capacity))
    for own in bins.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= own[0][2]


@pytest.mark.parametrize("sizes", [[3, 3, 2, 2, 2], [4, 4, 4], [1] * 7, [4, 3, 3, 2, 1, 1], [2, 2, 2, 2, 3], [4, 1]])
def test_packing_against_every_plan(sizes):
    """Best fit opens bins greedily; on small groups it is held against the cheapest of all partitions."""
    capacities, cost = (2, 4), packing.SEQUENCE_COST

    def cheapest(left, bins):
        if not left:
            return sum(min(c for c in capacities if c >= b) + cost for b in bins)
        best = cheapest(left[1:], [*bins, left[0]])
        for i, b in enumerate(bins):
            if b + left[0] <= max(capacities):
                best = min(best, cheapest(left[1:], [*bins[:i], b + left[0], *bins[i + 1 :]]))
        return best

    where, final = packing.best_plan(sorted(sizes, reverse=True), capacities)
    assert sum(final) + cost * len(final) == cheapest(sizes, [])
    assert len(where) == len(sizes)


def test_packing_is_tight_and_no_worse_than_one_size():
    rng = random.Random(7)
    sizes = sorted((min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    _, final = packing.best_plan(sizes)
    _, single = packing.best_plan(sizes, (4096,))
    cost = lambda f: sum(f) + packing.SEQUENCE_COST * len(f)
    assert sum(sizes) / sum(final) > 0.97 and cost(final) <= cost(single)


# --- op5 n-gram join


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for j, k in collections.Counter(j for g in s for j in lists[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            lists[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed):
    """Groups of near copies at many distances, chains among them, and strangers."""
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 150))]
        for _ in range(rng.randrange(2, 40)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(t)))
            if rng.random() < 0.2:
                base = t
    return rows + [(len(rows) + k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60)))) for k in range(40)]


@pytest.mark.parametrize(("words", "percent", "small", "long", "heavy", "seed"), [(3, 90, 64, 32, 1 << 18, 1), (5, 80, 64, 3, 1 << 8, 2), (3, 90, 4, 3, 1 << 18, 3), (5, 80, 4, 5, 1 << 10, 4), (2, 60, 3, 2, 1 << 8, 5), (1, 30, 64, 32, 1 << 8, 6)])
def test_components_of_near_copies(spark, monkeypatch, words, percent, small, long, heavy, seed):
    for name, value in (("LONG", long), ("SMALL", small), ("HEAVY", heavy), ("BLOCK", 16), ("QUERIES", 8), ("PIVOTS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(seed)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_components_of_the_documents(spark, docs, texts):
    for words, percent in ((3, 90), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, words, percent).collect()}
        assert got == brute_components(sorted(texts.items()), words, percent)


def test_components_of_long_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(0, " ".join(base)), (1, " ".join(base[1000:])), (2, " ".join(base[:30_000])), (3, " ".join(reversed(base)))]
    got = {r.id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_linked_sets_share_the_lists_that_are_asked_for():
    rng = np.random.RandomState(0)
    met = 0
    for percent in (30, 60, 80, 90):
        for _ in range(300):
            n = rng.randint(2, 300)
            a = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64))
            heavy = np.sort(rng.permutation(a)[: rng.randint(0, n)])
            change = int(len(a) * rng.uniform(0, 0.12))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[change:]], rng.randint(0, 1 << 62, rng.randint(0, change + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                met += 1
                shared = len(np.intersect1d(*(ngram_join.indexed(s, heavy, percent) for s in (a, b))))
                needed = -(-percent * (len(a) + len(b)) // (100 + percent))
                asked = needed - max(ngram_join.set_aside(len(s), percent) for s in (a, b))
                assert shared >= asked >= 1
    assert met > 600


def test_linked_sets_share_the_groups_that_are_asked_for():
    rng = np.random.RandomState(1)
    met = 0
    for percent in (85, 90, 97):
        for _ in range(600):
            a = np.unique(rng.randint(0, 1 << 62, rng.randint(2, 400)).astype(np.uint64) << np.uint64(2))
            change = int(len(a) * rng.uniform(0, 0.2))
            new = rng.randint(0, 1 << 62, rng.randint(0, change + 1)).astype(np.uint64) << np.uint64(2)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[change:]], new]))
            both = len(np.intersect1d(a, b))
            if len(b) and both < max(len(a), len(b)) and 100 * both >= percent * (len(a) + len(b) - both):
                met += 1
                shared = len(np.intersect1d(ngram_join.groups(a, percent), ngram_join.groups(b, percent)))
                (own_a, fewest_a), (own_b, fewest_b) = (ngram_join.groups_asked(len(s), percent) for s in (a, b))
                assert shared >= min(own_a, own_b) >= max(fewest_a, fewest_b) >= 2
    assert met > 300


def test_strangers_with_common_words_are_no_candidates(spark, monkeypatch):
    """Every shingle is in many texts, so lists of single shingles tie most of them into one part."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(40, 90)))) for k in range(300)]
    rows.append((300, rows[7][1] + " g"))
    sizes = {}

    def counted(df, name):
        out = ngram_join_stored(df, name)
        sizes[name] = out.count() if name == "candidates" else sizes.get(name)
        return out

    ngram_join_stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", counted)
    got = {r.id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == {k: 7 if k == 300 else k for k, _ in rows}
    assert sizes["candidates"] <= 20


@pytest.mark.parametrize("heap", [0, 1 << 20])
def test_search_finds_what_links(monkeypatch, heap):
    monkeypatch.setattr(ngram_join, "HEAP", heap)
    rng = np.random.RandomState(3)
    sets = [np.unique(rng.randint(0, 60, rng.randint(1, 50)).astype(np.uint64)) for _ in range(60)]
    index = ngram_join.InvertedLists(sets)
    for q in sets:
        want = [d for d, s in enumerate(sets) if 10 * len(np.intersect1d(q, s)) >= 8 * len(np.union1d(q, s))]
        assert index.search(q, 80) == want


def test_odd_rows_in_the_join(odd):
    got = collections.defaultdict(set)
    for r in ngram_join.ngram_components(odd, 3, 90).collect():
        got[r.id].add((r.n_shingles, r.component_id))
    assert got[1] == {(0, 1)} and got[3] == {(0, 3)} and got[4] == got[5] == {(3, 4)} and got[None] == {(3, None)}
    kept = {r.doc_id for r in ngram_join.keep_representatives(odd, 3, 90).collect()}
    assert 5 not in kept and {1, 2, 3, 4, None} <= kept


@pytest.mark.parametrize("chunk", [1, 4, 1 << 19])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components_module, "CHUNK_EDGES", chunk)
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *((k, k + 1) for k in range(20, 60))]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()
    got = {r.node: r.label for r in rows}
    assert len(rows) == len(got)
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 61)}}


# --- op10 licence scan


def test_licences(spark):
    model = license_scan.train(spark)
    texts_ = {
        1: "Some words.\nReleased under the MIT License.\nMore.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.", 4: "Licensed under the Apache License, Version 2.0.",
        5: "He has a license to drive.", 6: "Nothing here.", 7: None, 8: "", 9: "We took it. Licensed under the Apache License, Version 2.0. And went\nReleased under the MIT License.",
    }
    rows = spark.createDataFrame([(k, t) for k, t in texts_.items()], "doc_id int, text string")
    got = {r.id: (r.families, r.n_notices) for r in license_scan.scan_licences(rows, model=model).collect()}
    assert got == {1: ("mit", 1), 2: ("gpl", 1), 3: ("cc-by-nc", 1), 4: ("apache", 1), 5: (None, 0), 6: (None, 0), 7: (None, 0), 8: (None, 0), 9: ("apache,mit", 2)}


def test_wrapped_licences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
    texts_ = {
        1: f"Some words here.\n\n{gpl}\n\nMore words.", 2: "This work is licensed under the\nApache License,\nVersion 2.0.", 3: f"Released under the MIT License.\n{gpl}",
        4: f"{gpl}\n\nThe end of it.\n\nReleased under\nthe MIT License.", 5: "This work is licensed under the\n\nhouse. The Apache\npeople came, version two.",
        6: "He had a license\nto drive in\nthe city.", 7: "\n\n", 8: "// Licensed under the\n// Mozilla Public\n// License, version 2.0",
    }
    rows = spark.createDataFrame([(k, t) for k, t in texts_.items()], "doc_id int, text string")
    got = {r.id: (r.licence, r.families, r.n_notices) for r in license_scan.scan_licences(rows).collect()}
    assert got[1] == ("gpl", "gpl", 1) and got[2] == ("apache", "apache", 1) and got[8] == ("mpl", "mpl", 1)
    assert got[3][1:] == got[4][1:] == ("gpl,mit", 2)
    assert got[5][0] in (None, "unknown") and got[6][0] in (None, "unknown") and got[7] == (None, None, 0)


def test_licences_outside_the_families(spark):
    texts_ = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", 2: "Licensed under the Apache\nLicense, Version 2.0",
        3: "This program is licensed under the Eclipse Public License 2.0", 4: "Licensed under the EUPL 1.2", 5: "SPDX-License-Identifier: MIT", 6: "// SPDX-License-Identifier: GPL-2.0-only\nint main() {}", 7: "Licensed under the Sleepycat Public License, version 1",
    }
    rows = spark.createDataFrame(list(texts_.items()), "doc_id int, text string")
    got = {r.id: r.licence for r in license_scan.scan_licences(rows).collect()}
    assert got == {1: "mit", 2: "apache", 3: "unknown", 4: "unknown", 5: "mit", 6: "gpl", 7: "unknown"}


# --- pipeline


def test_pipeline_against_brute_force(spark, docs, texts):
    import corpus_pipeline as cp

    got = {}
    df = docs
    for name, stage in cp.STAGES:
        df = spark.createDataFrame(stage(spark, df, SF).collect(), schema=stage(spark, df, SF).schema)
        got[name] = df
        if name != "packing":
            assert df.columns == docs.columns
    left = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in got["language"].collect()} == left.keys()
    last = {}
    for i in sorted(left):
        last[lowered(left[i])] = i
    left = {i: left[i] for i in last.values()}
    assert {r.doc_id for r in got["exact"].collect()} == left.keys()
    comps = brute_components(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if comps[i][1] == i}
    assert {r.doc_id for r in got["near"].collect()} == left.keys()
    finder = decontamination.PassageFinder([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = {i: t for i, t in left.items() if not finder.find(np.frombuffer(t.encode(), np.uint8))}
    assert {r.doc_id for r in got["benchmark"].collect()} == left.keys()
    total = collections.Counter()
    for r in got["packing"].collect():
        total[r.doc_id] += r.tokens
    assert total == {i: len(t.encode().split()) + 1 for i, t in left.items()}
