"""Semantics that single operators promise, on small inputs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankwell.functions import scores, text, vectors
from rankwell.operators import changes, documents, graph, lexicon, pipeline, reranker, search, slots, triage
from rankwell.operators.documents import DocumentConfig
from rankwell.sources import tables

ROOT = Path(__file__).parent.parent


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("answer", "score"),
    [('{"score": 7}', 7), ("3", 3), ('{"rating": 6}', 6), ("ok\nScore: 5\nend", 5), ("15", 9), ("-3", 0), ("true", 1), ("7.9", 7), ("none", None), ("", None), ('{"relevance": 2}', 2)],
)
def test_score_parser(spark, answer, score):
    assert one(spark, scores.parsed_score(F.lit(answer))) == score


def test_unreadable_answer_keeps_the_base(spark):
    assert one(spark, scores.adjusted(F.lit(0.4), F.lit("?"))) == 0.4
    assert one(spark, scores.adjusted(F.lit(0.9), F.lit("9"))) == 1.0


@pytest.mark.parametrize(("p", "zone", "sure"), [(0.6, "accepted", True), (0.4, "needs_review", True), (0.39, "rejected", True), (0.5, "needs_review", False)])
def test_probability_edges(spark, p, zone, sure):
    assert one(spark, scores.probability_zone(F.lit(p))) == zone
    assert one(spark, scores.confident(F.lit(p))) == sure


def test_cosine_of_nulls_zeros_and_unequal_sizes(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, vectors.cosine(a, F.lit(None).cast("array<double>"))) == 0.0
    assert one(spark, vectors.cosine(a, a)) == 1.0


@pytest.mark.parametrize(("given", "wanted"), [("1th", "1st"), ("22th", "22nd"), ("13th", "13th"), ("11st", "11th"), ("103th", "103rd"), ("4st", "4th"), ("112nd", "112th")])
def test_ordinals(spark, given, wanted):
    assert one(spark, text.ordinals_fixed(F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Fifth Amendment § 2", "5th Amendment Section 2"), ("the 14th  amendment", "14th Amendment"), ("no such thing", None), ("twenty-first amendment", "21st Amendment")])
def test_amendment_titles(spark, given, wanted):
    assert one(spark, lexicon.amendment_title(F.lit(given))) == wanted


def test_triage_gap_and_best(spark):
    rows = spark.createDataFrame([(1, 1, 0.92, 1), (1, 2, 0.85, 2), (1, 3, 0.70, 3), (1, 1, 0.95, 4)], "query_id int, doc_id int, score double, ord int").withColumn("source_ord", F.lit(0))
    assert {r.doc_id for r in triage.within_gap(rows.where("ord < 4"), 0.10).collect()} == {1, 2}
    best = {r.doc_id: r.score for r in triage.keep_best(rows, ["query_id", "doc_id"]).collect()}
    assert best[1] == 0.95
    assert {r.doc_id: r.score for r in triage.keep_first(rows, ["query_id", "doc_id"]).collect()}[1] == 0.92
    zones = [r.zone for r in triage.classified(rows.where("ord < 4")).orderBy("ord").collect()]
    assert zones == ["accepted", "accepted", "needs_review"]


def test_loop_is_found_before_the_hop_limit(spark):
    nodes = spark.createDataFrame([("a", False, "b"), ("b", False, "c"), ("c", False, "a"), ("d", False, "e"), ("e", True, None), ("f", False, None)], "query string, has_results boolean, next string")
    got = {r.query: r for r in graph.rephrase_chains(nodes.select("query"), nodes, max_hops=2).collect()}
    assert got["a"].loop_detected and got["a"].chain == ["a", "b", "c"] and not got["a"].hit_max_hops
    assert got["d"].hit and got["d"].final == "e" and got["d"].hops == 1
    assert not got["f"].hit and not got["f"].loop_detected
    assert {r.query: r for r in graph.rephrase_chains(nodes.select("query"), nodes, max_hops=1).collect()}["a"].hit_max_hops


def test_links_replace_and_never_point_at_themselves(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    n = spark.createDataFrame([("a", "x"), ("c", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.linked(e, n).collect()} == {("a", "x"), ("c", "d")}


def test_ancestors_stop_at_circles(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None), ("s", "r"), ("t", "s")], "id string, parent_id string")
    got = {r.id: r.ancestors for r in documents.with_ancestors(n).collect()}
    assert got["t"] == ["r", "s"] and got["r"] == [] and got["a"] == ["b"]


def test_ingest_skips_what_has_neither_title_nor_text(spark):
    d = spark.createDataFrame([("1", " A ", "", "x", "p"), ("2", None, " \n", None, None), ("3", "", "body", None, "0")], "id string, title string, text string, chapter string, section string")
    got = {r.id: r for r in documents.ingested(d, DocumentConfig(hierarchy=("chapter", "section"))).collect()}
    assert got["1"].path == "x / p" and got["1"].depth == 2 and got["1"].embed_text == "A x p"
    assert got["2"].status == "skipped" and got["3"].status == "ok" and got["3"].depth == 0


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    new = spark.createDataFrame([(2, " b "), (3, "x"), (4, "d")], "k int, t string")
    assert {r.k: r.change for r in changes.changed(old, new, "k", ["t"]).collect()} == {1: "deleted", 2: "same", 3: "updated", 4: "new"}


def test_clauses_are_packed_and_lose_nothing(spark):
    t = "aa\n\nbb\n\n" + "This is long. " * 5 + "\n\ncc"
    got = one(spark, text.split_clauses(F.lit(t), 30))
    assert got[0] == "aa\n\nbb\n\nThis is long." and all(len(c) <= 30 for c in got) and "".join(got).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "")


def test_scrub_and_clean(spark):
    assert one(spark, text.scrub_personal(F.lit("Mail a.b@c.org or 415-555-1234 now"))) == "Mail or now"
    assert one(spark, text.clean_summary(F.lit("```json\nSummary: `x`\n```"))) == "x"
    assert one(spark, text.unless_refused(F.lit("I'm sorry, no"))) is None


def test_html(spark):
    page = "<html><nav>menu</nav><script>x()</script><p>A &amp; B</p><!-- no --><style>p{}</style> end</html>"
    assert one(spark, tables.html_text(F.lit(page))) == "A & B end"


def test_json_csv_and_xml_sources(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"data": {"law": {"articles": [{"title": "A"}, {"title": "B"}]}}}')
    assert tables.knowledge_json(spark, str(tmp_path / "k.json")).count() == 2
    (tmp_path / "c.json").write_text('{"cases": {"x": [{"case": "A v B", "summary": "s", "references": ["r"]}, "C v D"]}}')
    got = {r.case: r.references for r in tables.cases_json(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"A v B": ["r"], "C v D": []}
    (tmp_path / "q.csv").write_text('Question,Case,Related to\n"What, why?",2,"a, b"\n')
    row = tables.question_csv(spark, str(tmp_path / "q.csv")).first()
    assert (row.question, row.level, row.topics) == ("What, why?", 2, ["a", "b"])
    (tmp_path / "x.xml").write_text("<r><s><n>1</n></s><s><n>2</n></s></r>")
    assert tables.xml_rows(spark, str(tmp_path / "x.xml"), "s", "n int").agg(F.sum("n")).first()[0] == 3
    assert tables.nothing(spark, "a int").count() == 0


def test_failing_slot_gives_nulls(spark):
    def broken(texts):
        raise RuntimeError

    rows = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    assert [r.x for r in slots.with_slot(rows, "t", broken, "string", "x").collect()] == [None] * 3


def test_rephrase_loop_answers_what_is_left(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, embedding array<double>")
    q = spark.createDataFrame([(10, "x", [1.0, 0.0]), (11, "far", [-1.0, -1.0])], "query_id bigint, text string, embedding array<double>")

    def embed(d):
        v = F.when(F.col("text") == "near", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("embedding"))
        return d.withColumn("embedding", v)

    s = pipeline.Stages(embed=embed, rephrase=lambda d: d.select("query_id", F.lit("near").alias("text")))
    got = {(r.query_id, r.doc_id, r.attempt) for r in pipeline.run(q, corpus, s=s).collect()}
    assert got == {(10, 1, 0), (11, 2, 1)}


def test_judgements(spark):
    c = spark.createDataFrame([(1, "A ", 1), (1, "B", 2), (1, "C", 9)], "query_id int, title string, ord int")
    j = spark.createDataFrame([(1, "a", 0.9)], "query_id int, title string, score double")
    assert {r.title: r.label for r in reranker.judgement_rows(c, j).collect()} == {"A ": 1, "B": 0}
    assert reranker.better(0.5, None) and not reranker.better(0.4, 0.5)


def test_hierarchy_titles_and_children(spark):
    d = spark.createDataFrame([("1", "2", " ", "body"), ("1", None, "T", " ")], "a string, s string, t string, x string")
    got = documents.to_hierarchy(d, {"article": "a", "section": "s"}, F.col("t"), F.col("x")).collect()
    assert got[0].title == "Article 1 Section 2" and [c.text for c in got[0].clauses] == ["body"]
    assert got[1].title == "T" and got[1].clauses == []


def test_sections_are_grouped_in_numeric_order(spark):
    d = spark.createDataFrame([("k", "B", [("10", "x")]), ("k", "A", [("9", "y"), ("z", "w")])], "k string, t string, sections array<struct<number:string,text:string>>")
    row = documents.grouped_sections(d, ["k"], "t", "sections").first()
    assert row.t == "A" and [s.number for s in row.sections] == ["9", "10", "z"]


def test_repairs(spark):
    c = F.array(F.struct(F.lit(" ").alias("text")), F.struct(F.lit("Next ").alias("text")), F.struct(F.lit("abcdef").alias("text")))
    assert [x.text for x in one(spark, text.repaired_clauses(c, most=3))] == ["abc"]
    assert one(spark, text.entities_resolved(F.lit("(b) &sect;&nbsp;1 “x”"))) == '(2) § 1 "x"'


def test_reranker_learns_and_is_kept_only_if_better(spark):
    rows = spark.range(300).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0 - 1).alias("x"), F.lit(0.5).alias("z")).withColumn("label", (F.col("x") > 0).cast("double"))
    model, used = reranker.retrained(rows, ["x", "z"], None)
    assert used and reranker.auc(reranker.scored(rows, model, ["x", "z"])) > 0.95
    best = reranker.random_search(rows, ["x", "z"], tries=2)
    assert len(best) == 2 and best[0][0] >= best[1][0]
    assert reranker.permutation_importance(rows, model, ["x", "z"])[0][0] == "x"
    metrics = reranker.classifier_metrics(reranker.scored(rows, model, ["x", "z"])).first()
    assert metrics.f1 > 0.9
    calibrated = reranker.calibrator(reranker.scored(rows, model, ["x", "z"])).transform(reranker.scored(rows, model, ["x", "z"]))
    assert calibrated.agg(F.min("calibrated"), F.max("calibrated")).first()[1] <= 1.0


def test_vector_topk_takes_ids_of_any_type(spark):
    rows = [(f"d{k}", [float(k % 5), 1.0, 0.5]) for k in range(40)] + [(None, [1.0, 1.0, 1.0]), ("short", [1.0]), ("null", None), ("hole", [1.0, None, 2.0]), ("zero", [0.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id int, embedding array<double>")
    got = [(r.query_id, r.ord, r.doc_id, r.score) for r in search.vector_topk(docs, asked, 3).orderBy("query_id", "ord").collect()]
    assert got == [(1, 1, "d1", 1.0), (1, 2, "d11", 1.0), (1, 3, "d16", 1.0), (2, 1, "d0", 0.0), (2, 2, "d1", 0.0), (2, 3, "d10", 0.0)]
    own = search.vector_topk(docs, docs.select(F.col("doc_id").alias("query_id"), "embedding").where("doc_id = 'd7'"), 40).collect()
    assert {r.query_id for r in own} == {"d7"} and "d7" not in {r.doc_id for r in own} and len(own) == 40


def test_library_stands_without_the_training_data_operators(tmp_path):
    for name in ("rankwell", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if not source.exists():
            continue
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "rankwell/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'vector_topk' in q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert s.keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})


def test_answers_of_every_form(spark):
    from rankwell.functions import answers

    rows = [("Score: 7", 7), ("Score: 12 of 3", 3), ("it is 4 or 6.", 6), ("SCORE: Nine", 9), ("nothing", 5), ("", 5), (None, 5)]
    found = spark.createDataFrame(rows, "answer string, wanted int").select("wanted", answers.verified_score(F.col("answer")).alias("score")).collect()
    assert [r.score for r in found] == [r.wanted for r in found]


def test_bare_amendments(spark):
    from rankwell.operators import lexicon

    titles = spark.createDataFrame([("1st Amendment",), ("12th Amendment",), ("22nd Amendment",)], "title string")
    rows = [("the First", "1st Amendment"), ("one", "1st Amendment"), ("12", "12th Amendment"), ("twenty second", "22nd Amendment"), ("1st amendment", None), ("9", None), ("0", None), ("first rule", None), ("99999999999", None), ("", None), (None, None)]
    found = lexicon.bare_amendments(spark.createDataFrame(rows, "asked string, wanted string"), titles, "asked").collect()
    assert {(r.asked, r.title) for r in found} == set(rows)


@pytest.mark.parametrize(("words", "spanish"), [("Ñandú", True), ("CIÓNÑMI", True), ("Los", True), ("lo\u017f dos", True), ("LEY.", True), ("¿Y?", True), ("Éléments", False), ("losa", False), ("", False), (None, None)])
def test_spanish_signs_in_capitals(spark, words, spanish):
    assert one(spark, slots.looks_spanish(F.lit(words).cast("string"))) is spanish
