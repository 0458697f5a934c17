"""Exact folds, calibration, permutation importance, remembered answers and the change stream against brute-force versions."""

import collections
import datetime
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import ranks, reranker, slots
from rankwell.operators.changes import changed
from rankwell.streaming.changes import Watch, due


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(i, float(rng.random() < 0.2), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]
    rows = [(i, y, x + 2 * y, z) for i, y, x, z in rows]
    return rows, spark.createDataFrame(rows, "id long, label double, x double, z double")


# --- ranks and folds


@pytest.mark.parametrize("size", [1024, 7])
def test_ranks_are_a_random_order(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "ROWS", size)
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0] if i % 11 else None) for i in range(500)] + [(1, "a"), (1, "a")], "i long, g string")
    for by in (None, "g"):
        got = collections.defaultdict(list)
        for r in ranks.seeded_ranks(df, ["i"], 5, "place", by).collect():
            got[r.g if by else 0].append((r.place, r.i))
        assert sum(map(len, got.values())) == 502
        for own in got.values():
            own.sort()
            assert [p for p, _ in own] == list(range(len(own)))
            assert [i for _, i in own] != sorted(i for _, i in own)
    other = {r.i: r.place for r in ranks.seeded_ranks(df.where("i > 1"), ["i"], 6, "place").collect()}
    same = sum(other[r.i] == r.place for r in ranks.seeded_ranks(df.where("i > 1"), ["i"], 5, "place").collect())
    assert same < 20


@pytest.mark.parametrize("k", [2, 5])
def test_folds_are_stratified_exactly(spark, k):
    rows, df = labelled(spark)
    got = reranker.stratified_folds(df.unionByName(spark.createDataFrame([(9000 + i, None, 0.0, 0.0) for i in range(4)], df.schema)), "label", "id", k)
    counts = collections.Counter((r.label, r.fold) for r in got.collect())
    for label in (0.0, 1.0, None):
        own = [counts[label, f] for f in range(k)]
        assert max(own) - min(own) <= 1
    assert sum(counts.values()) == len(rows) + 4


# --- calibration


def isotonic(points):
    """Pool adjacent violators over (p, y), ties of p pooled first; a function of p by interpolation."""
    by = collections.defaultdict(list)
    for p, y in points:
        by[p].append(y)
    blocks = [[sum(y) / len(y), len(y), [p]] for p, y in sorted(by.items())]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            v, n, ps = out.pop()
            w, m, qs = out.pop()
            out.append([(v * n + w * m) / (n + m), n + m, qs + ps])
    xs, ys = [], []
    for v, _, ps in out:
        xs += [ps[0], ps[-1]] if ps[0] != ps[-1] else [ps[0]]
        ys += [v] * (2 if ps[0] != ps[-1] else 1)
    return lambda p: float(np.interp(p, xs, ys))


def test_calibration_uses_the_other_folds_only(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.random() < (i % 50) / 50), (i % 50) / 50, i % 3) for i in range(300)]
    got = reranker.cross_calibrated(spark.createDataFrame(rows, "id long, label double, p double, fold int"), k=3).collect()
    assert len(got) == 300
    for f in range(3):
        curve = isotonic([(p, y) for _, y, p, g in rows if g != f])
        for r in got:
            if r.fold == f:
                assert r.calibrated == pytest.approx(curve(r.p), abs=1e-6)


def test_out_of_fold_models_do_not_see_their_fold(spark):
    # in fold 0 the label is the other way round, which no model of the other folds can know
    rows = [(i, float((i % 2 == 0) != (i % 3 == 0)), float(i % 2 == 0) + 0.01 * (i % 7), i % 3) for i in range(240)]
    got = reranker.out_of_fold(spark.createDataFrame(rows, "id long, label double, x double, fold int"), ["x"], k=3, kind="logistic").collect()
    assert len(got) == 240
    assert sum((r.p >= 0.5) == (r.label == 1) for r in got if r.fold == 0) < 20


# --- permutation importance


def test_permuted_columns_keep_their_values(spark):
    rows, df = labelled(spark, 400)
    got = collections.defaultdict(list)
    for r in reranker.permuted(df, ["x", "z"], "id", repeats=2).collect():
        got[r.feature, r.repeat].append((r.id, r.label, r.x, r.z))
    assert got.keys() == {(None, 0), ("x", 0), ("x", 1), ("z", 0), ("z", 1)}
    assert sorted(got[None, 0]) == sorted(rows)
    for (feature, _), own in got.items():
        if feature:
            j = {"x": 2, "z": 3}[feature]
            assert sorted(r[j] for r in own) == sorted(r[j] for r in rows)
            plain = {r[0]: r for r in rows}
            assert all(r[:2] == plain[r[0]][:2] and r[5 - j] == plain[r[0]][5 - j] for r in own)
            assert sum(r[j] == plain[r[0]][j] for r in own) < 20
    assert sorted(got["x", 0]) != sorted(got["x", 1])


def test_importance_by_hand(spark):
    rows, df = labelled(spark, 400)
    model = reranker.fit(df, ["x", "z"], kind="logistic")

    def f1(scored):
        tp = sum(r.p >= 0.5 and r.label == 1 for r in scored)
        wrong = sum((r.p >= 0.5) != (r.label == 1) for r in scored)
        return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0

    by = collections.defaultdict(list)
    for r in reranker.scored(reranker.permuted(df, ["x", "z"], "id", 3), model, ["x", "z"]).collect():
        by[r.feature, r.repeat].append(r)
    base = f1(by[None, 0])
    got = {r.feature: (r.importance_mean, r.importance_std) for r in reranker.importances(df, model, ["x", "z"], "id").collect()}
    for feature in "xz":
        losses = [base - f1(by[feature, k]) for k in range(3)]
        assert got[feature] == pytest.approx((np.mean(losses), np.std(losses)), abs=1e-6)
    assert got["x"][0] > 0.2 > abs(got["z"][0])


# --- remembered answers


def counting(folder, fails):
    """A slot that writes down its calls and fails as asked."""

    def fn(prompts, attempt):
        (folder / uuid.uuid4().hex).write_text("\n".join([str(attempt), *prompts]))
        if fails(prompts, attempt):
            raise TimeoutError("busy")
        return [p.upper() for p in prompts]

    return fn


def calls(folder):
    return [p.read_text().split("\n") for p in folder.iterdir()]


PROMPTS = [(i, None if i % 17 == 0 else f"p{i % 40}") for i in range(120)]


def told(df):
    return sorted(((r.id, r.answer, r.status.ok) for r in df.collect()), key=repr)


def test_a_failing_slot_ends_with_the_same_answers(spark, tmp_path):
    df = spark.createDataFrame(PROMPTS, "id int, text string").withColumns({c: F.lit(1) for c in ("hash", "prompt", "error", "attempts")})
    want = sorted(((i, t and t.upper(), t is not None) for i, t in PROMPTS), key=repr)
    for name, fails in (("never", lambda p, n: False), ("often", lambda p, n: n < 3 and int(p[0][1:]) % 3 == 0)):
        (tmp_path / name).mkdir()
        out = slots.answered(df, "text", counting(tmp_path / name, fails), slots.Memo(f"{tmp_path}/{name}-memo"), batch=4)
        assert told(out) == want
    distinct = {t for _, t in PROMPTS if t}
    assert sorted(p for c in calls(tmp_path / "never") for p in c[1:]) == sorted(distinct)
    # asked again in the next rounds: only what failed
    asked = collections.Counter(c[0] for c in calls(tmp_path / "often") for _ in c[1:])
    assert asked["1"] == len(distinct) and 0 < asked["2"] < len(distinct) and asked["3"] == asked["2"]


def test_nothing_is_asked_twice_over_runs(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    memo, fn = slots.Memo(f"{tmp_path}/memo"), counting(tmp_path / "calls", lambda p, n: False)
    first = spark.createDataFrame(PROMPTS[:50], "id int, text string")
    whole = spark.createDataFrame(PROMPTS, "id int, text string")
    slots.answered(first, "text", fn, memo).count()
    slots.answered(whole, "text", fn, memo).count()
    slots.answered(whole, "text", fn, memo).count()
    said = [p for c in calls(tmp_path / "calls") for p in c[1:]]
    assert sorted(said) == sorted({t for _, t in PROMPTS if t})


def test_what_keeps_failing_says_why(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    out = slots.answered(df, "text", counting(tmp_path / "calls", lambda p, n: "a" in p), slots.Memo(f"{tmp_path}/memo"), rounds=2, batch=1)
    got = {r.id: (r.answer, tuple(r.status)) for r in out.collect()}
    assert got == {1: (None, (False, 2, "TimeoutError: busy")), 2: ("B", (True, 1, None)), 3: (None, (False, 0, None))}
    assert slots.answered(df.limit(0), "text", counting(tmp_path / "calls", lambda p, n: False), slots.Memo(f"{tmp_path}/other")).count() == 0


# --- change stream


def test_two_runs_give_the_difference_and_a_rerun_nothing(spark, tmp_path):
    schema = "k long, text string, n int"
    days = [
        [(1, "a", 1), (2, " b", 1), (3, None, 1), (4, "d", None), (None, "x", 1)],
        [(1, "a ", 1), (2, "c", 1), (3, None, 2), (5, "e", 1)],
        [(1, "z", 1), (2, "c", 1), (3, None, 2), (4, "d", None), (5, "e", 1)],
    ]
    frames = [spark.createDataFrame(d, schema) for d in days]
    watch = Watch(f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c", "k", ("text", "n"))
    watch.run(spark)  # nothing there yet
    for i, frame in enumerate(frames[:2], 1):
        assert watch.add(frame) == i
        watch.run(spark)
    want = {(r.k, r.change) for r in changed(frames[0].where("k IS NOT NULL"), frames[1], "k", ["text", "n"]).collect() if r.change != "same"}
    assert {(r.k, r.change) for r in watch.changes(spark, 2).collect()} == want == {(2, "updated"), (3, "updated"), (4, "deleted"), (5, "new")}
    rows = spark.read.parquet(watch.out).count()
    watch.run(spark)
    assert spark.read.parquet(watch.out).count() == rows
    watch.add(frames[2])
    watch.run(spark)
    # 4 is back as it was
    assert {(r.k, r.change, r.version) for r in watch.changes(spark, 3).collect()} == {(1, "updated", 2)}


def test_when_a_run_is_due():
    at = datetime.datetime(2024, 5, 1)
    assert due(None, at)
    assert not due(at, at + datetime.timedelta(days=6, hours=23)) and due(at, at + datetime.timedelta(days=7))


# --- stored models


def test_a_stored_model_scores_alike(spark, tmp_path):
    _, df = labelled(spark, 200)
    for kind in ("logistic", "mlp"):
        model = reranker.fit(df, ["x", "z"], kind=kind, hidden=(4,))
        for _ in range(2):  # an older one is replaced
            reranker.save_model(model, f"{tmp_path}/m", ["x", "z"], {"kind": kind, "f1": 0.5})
        again, features, about = reranker.load_model(spark, f"{tmp_path}/m")
        assert features == ["x", "z"] and about == {"kind": kind, "f1": 0.5}
        p = lambda m: [r.p for r in reranker.scored(df, m, features).orderBy("id").collect()]  # noqa: B023, E731
        assert p(model) == p(again)


def test_refusals_of_every_form(spark):
    from rankwell.functions.text import unless_refused

    no = ["Sorry, I can't help you.", "i cannot assist with that request", "I am unable to help with that", "I am not able to do that", "I cannot fulfill that request.", "We are not able to provide that information", "This violates content policy", "I'm sorry, but I cannot"]
    yes = ["I can help you", "The policy violates nothing", "able to do that", ""]
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in [*no, *yes, None]], "t string").select("t", unless_refused(F.col("t")).alias("u")).collect()}
    assert all(got[t] is None for t in no) and all(got[t] == t for t in yes) and got[None] is None
