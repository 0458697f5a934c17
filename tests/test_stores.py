"""Stored results and insights, citations and features on odd rows."""

import pytest
from pyspark.sql import functions as F

from rankwell.functions.text import cited_regulations, clause_number
from rankwell.operators.evaluation import judged, judged_by_class, ranking_metrics
from rankwell.operators.features import NAMES, Domain, featured, flagged, match_type, vectors
from rankwell.operators.query_store import coerced, insights_saved, results_appended


def test_results_of_odd_forms(spark):
    rows = [
        (1, None), (2, "no json"), (3, "7"), (4, "[]"), (5, "{}"), (6, '""'), (7, '["title only", 0.2]'), (8, '[{"_id": {"$oid": "a"}, "title": " T "}, null]'), (9, '{"_id": 5, "text": "t", "score": 1, "cases": ["t", "u", {"case": "c"}, {"from_ref": "x", "case": "d"}, null, {}]}'), (10, '[{"$oid": "b"}, 2]'),
    ]
    got = {r.i: (r.knowledge_id, r.title, r.cases and [tuple(c) for c in r.cases], r.score) for r in coerced(spark.createDataFrame(rows, "i int, r string"), "r").collect()}
    none = (None, None, None, None)
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [none] * 6
    assert got[7] == (None, None, None, 0.2)
    assert got[8] == ("a", "T", None, None)
    assert got[9] == ("5", "t", [(None, "t", None), (None, "c", None)], 1.0)
    assert got[10] == ("b", None, None, 2.0)


def test_results_are_stored_once_per_collection(spark):
    schema = "query string, knowledge_id string, collection_key string, title string, cases array<struct<case_id: string, case: string, from_ref: string>>, score double, ord int"
    stored = spark.createDataFrame([("q", "1", "a", "A", None, 0.5, 0), ("q", None, None, "B", None, None, 1)], schema)
    new = spark.createDataFrame([(" Q ", "1", "a", "other", None, 0.9, 0), ("q", "1", "b", "A", None, 0.9, 1), ("q", None, "a", "B", None, 0.9, 2), ("q", None, None, None, None, None, 3), ("r", "1", "a", "A", None, None, 0)], schema)
    got = [(r.query, r.ord, r.knowledge_id, r.collection_key, r.title, r.score) for r in results_appended(stored, new).orderBy("query", "ord").collect()]
    assert got == [("q", 0, "1", "a", "A", 0.5), ("q", 1, None, None, "B", None), ("q", 2, "1", "b", "A", 0.9), ("q", 3, None, None, None, None), ("r", 0, "1", "a", "A", None)]


def test_insights_stay_within_the_results(spark):
    rows = [("q", 0, " Old ", "en", None, None, 1, 1), ("q", 0, "New  one", "en", None, "nuevo", 2, 2), ("q", 2, "x", "es", "", None, 1, 3), ("q", 3, "beyond", "en", None, None, 1, 4), ("q", -1, "below", "en", None, None, 1, 5), ("free", 9, None, "es", None, None, 1, 6)]
    got = insights_saved(spark.createDataFrame(rows, "query string, index int, text string, language string, text_en string, text_es string, at int, id int"), spark.createDataFrame([("q", 3)], "query string, n int"))
    assert {tuple(r) for r in got.collect()} == {("q", 0, "New  one", "nuevo", "new one"), ("q", 2, None, "x", "x"), ("free", 9, None, "", "")}


def test_citations_and_clause_numbers(spark):
    texts = {"See 8 CFR 216.4(a)(5)(iii) and 8 cfr 216.4": "8 CFR 216.4", "CFR 1.2; 9 CFR 1.2; 8 CFR 1.2 CFR 3.4.5": "8 CFR 1.2|CFR 3.4.5", "8 CFR": "", "": "", "8  CFR\n274a.12(c)(9)": "8 CFR 274a.12"}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert {r.t: r.c for r in rows.select("t", F.array_join(cited_regulations(F.col("t")), "|").alias("c")).collect()} == texts | {None: None}
    numbers = {"(a)": "(1)", "Z": "(26)", "((b))": "(2)", "12": "(12)", "§ 3": "(3)", "4A": "(4a)", "": "main", " ": "main", "§": "main", "(1)(2)": "main", "ab": "main", None: "main"}
    rows = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert {r.t: r.c for r in rows.select("t", clause_number(F.col("t")).alias("c")).collect()} == numbers


def test_relevance_by_class_is_that_of_pairs(spark):
    docs = spark.createDataFrame([(i, i % 3 if i < 20 else None) for i in range(25)] + [(90, 7)], "doc_id long, label int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (90, 7), (95, 2), (96, 8), (24, None)], "query_id long, label int")
    ranked = spark.createDataFrame([(0, 3, 1), (0, 4, 2), (1, 0, 1), (90, 5, 1), (95, 2, 1), (95, 99, 2), (24, 20, 1)], "query_id long, doc_id long, ord int")
    pairs = docs.join(queries, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    metrics = lambda rows: sorted(map(tuple, ranking_metrics(rows).collect()))
    assert metrics(judged_by_class(ranked, docs, queries)) == metrics(judged(ranked, pairs))


FEATURES = "query_id long, doc_id long, score double, query string, query_embedding array<float>, embedding array<float>, title string, text string, nested array<string>, keywords array<string>, aliases array<string>, article string, section string"


def test_features_of_odd_rows(spark):
    domain = Domain(4, {"title": "title", "article": "article", "section": "section", "unknown": "text"}, {"Speech": 0.1})
    rows = [
        (1, 1, 0.9, "free speech speech", [1.0, 0.0], [1.0, 1.0], "Speech", "about speech", [" more ", None], ["Spee", "speech"], ["SPEECH"], "I", ""),
        (1, 2, None, None, None, [1.0], None, None, None, None, None, None, None),
        (1, 3, 0.5, "free", [1.0, 0.0], [0.0, 0.0], "Free", "", [], ["x"], ["y", "free"], "", "2"),
    ]
    got = {r.doc_id: r.asDict() for r in featured(spark.createDataFrame(rows, FEATURES), domain).collect()}
    assert [n for n in got[1] if n in NAMES] == list(NAMES)
    assert got[2] == {"query_id": 1, "doc_id": 2} | dict.fromkeys(NAMES, 0.0) | {"domain_type": 4.0, "score_gap_from_top": 0.9}
    one, three = got[1], got[3]
    assert (one["alias_match"], one["keyword_match"], one["match_type"], one["section_depth"], one["bias_adjustment"], one["has_nested_content"]) == (1, 1, 1, 2, 0.1, 1)
    assert one["embedding_cosine_similarity"] == pytest.approx(0.5**0.5) and one["query_term_coverage"] == 0.5 and one["title_similarity"] == 0.5 and one["query_length"] == 18
    assert (three["alias_match"], three["keyword_match"], three["match_type"], three["query_term_coverage"], three["has_nested_content"], three["section_depth"]) == (1, 0, 2, 0, 0, 2)
    assert [len(r.vector) for r in vectors(featured(spark.createDataFrame(rows, FEATURES), domain)).collect()] == [15] * 3


def test_match_types_keep_the_order_of_the_lists(spark):
    rows = [("Bill of Rights", ["rights", "bill of rights"], None, 1), ("Bill of Rights", ["bill of rights", "rights"], None, 2), ("Rights", [], ["Rights"], 2), ("Rights", None, None, 1), ("Duties", None, None, 0), ("", ["x"], ["x"], 0), (None, ["x"], None, 0)]
    df = spark.createDataFrame(rows, "t string, k array<string>, a array<string>, want int")
    for r in df.select("want", match_type(F.col("t"), F.array(F.lit("my"), F.lit("rights")), F.col("k"), F.col("a")).alias("got"), flagged(F.col("t"), F.col("k")).alias("f")).collect():
        assert r.got == r.want
