"""Queries of the document model, audits, graph walks, lexicon and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import changes, documents, graph, lexicon
from ..operators.documents import DocumentConfig
from ..operators.search import fulltext_scores, term_matches
from ..sources.tables import html_text, table
from .retrieval import EVERY


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _items(spark, sf, every: int = EVERY):
    """Benchmark items as queries of a search: those whose id ``every`` divides."""
    return table(spark, sf, "benchmark").where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), "text")


def _title(c: str = "text"):
    """The first line stands in for a title."""
    return F.substring_index(F.col(c), "\n", 1)


def doc_tokens_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.round(F.log1p(F.length("text")), 6).alias("log_length"))


def _pairs(spark, sf):
    """Queries with all documents that hold one of their tokens: joined on tokens, so no other pair is made."""
    q = _items(spark, sf).select("query_id", text.tokens(F.col("text")).alias("q"))
    d = _docs(spark, sf).select("doc_id", "source", text.tokens(_title()).alias("title"), text.tokens(F.col("text")).alias("d"))
    return term_matches(q, d.select("doc_id", "d")).join(d, "doc_id").join(q, "query_id")


def title_jaccard(spark, sf):
    return _pairs(spark, sf).select("query_id", "doc_id", F.round(text.jaccard(F.col("q"), F.col("title")), 6).alias("jaccard"))


def term_coverage(spark, sf):
    return _pairs(spark, sf).select("query_id", "doc_id", F.round(F.col("matched") / F.size(F.array_distinct("q")), 6).alias("coverage"))


def bm25_score(spark, sf):
    return _pairs(spark, sf).select("query_id", "doc_id", F.round("bm25", 6).alias("score"))


def features(spark, sf):
    """The numeric part of the feature vector that needs only query, document and candidates."""
    rows = _pairs(spark, sf).select("query_id", "doc_id", "q", F.size("d").alias("length"), "title", "bm25", "matched")
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    return rows.select(
        "query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round(text.jaccard(F.col("q"), F.col("title")), 6).alias("title_jaccard"), F.round(F.col("matched") / F.size(F.array_distinct("q")), 6).alias("coverage"),
        F.round(F.log1p("length"), 6).alias("log_tokens"), F.round(top - F.col("bm25"), 6).alias("gap_from_top"), F.size(F.array_distinct("q")).cast("long").alias("query_terms"),
    )


def fulltext_search(spark, sf):
    d = _docs(spark, sf).withColumn("title", _title())
    return fulltext_scores(_items(spark, sf), d, {"title": 3.0, "text": 0.5}, 10)


def keyword_matches(spark, sf):
    """Dictionary: distinct first two words of part names; queries: part names."""
    parts = table(spark, sf, "part")
    terms = parts.select(F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ").alias("term")).distinct()
    q = parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return lexicon.word_matches(q, terms)


def match_kinds(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", lexicon.match_kind(F.col("p_name"), F.col("p_type")).alias("by_type"), lexicon.match_kind(F.col("p_brand"), F.upper("p_brand")).alias("by_brand"))


def alias_pairs(spark, sf):
    p = table(spark, sf, "part")
    return lexicon.unique_aliases(p.select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.upper("p_brand")).alias("alias")), "p_brand", "alias")


def dictionary_scan(spark, sf):
    d = lexicon.dictionary(table(spark, sf, "part"), "p_brand", "p_size")
    return d.select("p_brand", F.size("sections").cast("long").alias("n"), F.array_join(F.transform("sections", lambda x: x.cast("string")), ",").alias("sections"))


def clean_queries(spark, sf):
    return _items(spark, sf, 1).select("query_id", lexicon.cleaned_query(F.col("text")).alias("cleaned"), text.normalised(F.col("text")).alias("normalised"), text.truncated(F.col("text"), 5).alias("short"))


def _numbered(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("th amendment section "), F.col("c_nationkey").cast("string")).alias("t"))


def amendment_titles(spark, sf):
    return _numbered(spark, sf).select("c_custkey", lexicon.amendment_title(F.col("t")).alias("title"))


def articles_and_sections(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Article "), (F.col("c_nationkey") + 1).cast("string"), F.lit(", Section "), F.col("c_custkey").cast("string")).alias("t"))
    return c.select("c_custkey", lexicon.article_and_section(F.col("t")).alias("x")).select("c_custkey", "x.article", "x.section")


def ordinal_typos(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.ordinals_fixed(F.concat(F.col("c_custkey").cast("string"), F.lit("th item"))).alias("fixed"))


def _answers(spark, sf):
    k, v = F.pmod("event_id", F.lit(7)), F.pmod(F.floor("value").cast("long"), F.lit(14)) - 3
    s = v.cast("string")
    made = F.when(k == 0, F.concat(F.lit('{"score": '), s, F.lit("}"))).when(k == 1, s).when(k == 2, F.concat(F.lit('{"rating": '), s, F.lit("}"))).when(k == 3, F.concat(F.lit("Fine.\nScore: "), s, F.lit("\nEnd")))
    made = made.when(k == 4, F.concat(F.lit('{"relevance": '), s, F.lit(".7}"))).when(k == 5, "true").otherwise("no idea")
    return table(spark, sf, "events").select("event_id", made.alias("answer"), F.round(F.pmod("event_id", F.lit(100)) / 100.0, 2).alias("base"))


def score_parse(spark, sf):
    return _answers(spark, sf).select("event_id", scores.parsed_score(F.col("answer")).alias("score"))


def score_adjust(spark, sf):
    return _answers(spark, sf).select("event_id", F.round(scores.adjusted(F.col("base"), F.col("answer")), 6).alias("adjusted"))


def rephrase_chain(spark, sf):
    """Customers point at the next key, every fifth back by two; every seventh has results."""
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(k.alias("query"), (k % 7 == 0).alias("has_results"), F.when(k % 11 == 0, None).when(k % 5 == 0, k - 2).otherwise(k + 1).alias("next"))
    out = graph.rephrase_chains(nodes.select("query"), nodes)
    return out.withColumn("chain", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">"))


def ancestors_path(spark, sf):
    """Supplier -> nation -> region as one parent table."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent_id"))
    out = documents.with_ancestors(r.unionByName(n).unionByName(s))
    return out.select("id", F.array_join("ancestors", " / ").alias("path"), F.size("ancestors").cast("long").alias("depth"))


def ingest_enrich(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name")).alias("title"), F.col("r_name").alias("chapter"), F.col("n_name").alias("section"), F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("text"))
    return documents.ingested(rows, DocumentConfig(hierarchy=("chapter", "section")))


def ingest_summary(spark, sf):
    return ingest_enrich(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _order_children(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("title"), F.col("l_shipdate").cast("string").alias("text")).alias("child"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("child")).alias("children"))


def children_wrap(spark, sf):
    o = table(spark, sf, "orders").join(_order_children(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kids = documents.wrapped_children(F.transform("children", lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"))), F.col("o_orderpriority"), F.col("o_orderstatus"))
    return o.select("o_orderkey", F.size(kids).cast("long").alias("n"), F.get(kids, F.lit(0))["title"].alias("first_title"))


def full_texts(spark, sf):
    """Documents' text joined with their children's, as lengths."""
    o = table(spark, sf, "orders").join(_order_children(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", documents.full_text(F.col("o_orderpriority"), F.col("children")).alias("full_text"))


def sections_grouped(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 5), ",").alias("first_parts"))
    return li


def dup_titles(spark, sf):
    return documents.duplicate_groups(_docs(spark, sf).withColumn("title", F.lower(F.trim(_title()))), ["title"], "doc_id")


def dup_composite(spark, sf):
    return documents.duplicate_groups(_docs(spark, sf), ["text", "lang"], "doc_id").drop("text")


def dup_pattern(spark, sf):
    return documents.duplicate_patterns(table(spark, sf, "part"), "p_brand", ["p_type", "p_size"])


def dedupe_newest(spark, sf):
    return documents.newest_only(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def empty_text_docs(spark, sf):
    d = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 0, " \n").otherwise(F.col("text")))
    return documents.without_text(d, "text").select("conv_id", "turn")


def collection_stats(spark, sf):
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.length("text") > 1000).alias("long"), F.count_if(F.contains("text", F.lit("\n"))).alias("multi_line"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


def embedding_coverage(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    have = F.count_if(F.size(F.coalesce("v", F.array().cast("array<float>"))) > 0)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), have.alias("embedded"), F.round(have / F.count(F.lit(1)), 6).alias("share"))


def progress_by_group(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("number", text.first_number(F.col("p_brand")))


def dataset_statistics(spark, sf):
    return _docs(spark, sf).groupingSets([("lang",), ("source",), ()], "lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def top_by_children(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("n"), "l_orderkey").limit(20)


def children_sequential(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_partkey % 10 <> 0").select("l_orderkey", "l_linenumber")
    return documents.out_of_sequence(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


def dup_children(spark, sf):
    c = table(spark, sf, "conversations").where("trim(text) <> ''")
    return c.groupBy("conv_id", F.substring("text", 1, 100).alias("beginning")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id", "n")


def renumbered(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("number"))


def heading_carry(spark, sf):
    c = table(spark, sf, "conversations").withColumn("heading", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("H"), F.col("turn"))))
    return documents.carried_heading(c, "conv_id", "turn", "heading").select("conv_id", "turn", "current_heading")


def clause_merge(spark, sf):
    out = documents.merged_paragraphs(table(spark, sf, "conversations"), "conv_id", "turn", F.col("turn") % 3 == 0, "text")
    return out.select("conv_id", "clause", F.length("text").cast("long").alias("chars"))


def clause_split(spark, sf):
    d = _docs(spark, sf).select("doc_id", text.split_clauses(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("clauses"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).cast("long").alias("longest"))


def change_diff(spark, sf):
    d = _docs(spark, sf)
    old = d.where("doc_id % 5 <> 0")
    new = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit(" "), "text")))
    return changes.changed(old, new, "doc_id", ["text", "lang"])


def change_apply(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    return changes.change_set_applied(d.where("doc_id % 5 <> 0"), d.where("doc_id % 7 <> 0").withColumn("lang", F.lit("xx")), "doc_id")


def new_removed_existing(spark, sf):
    e = table(spark, sf, "events")
    return changes.split_sets(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id")


def merge_precedence(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("title"))
    a, b = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")
    return changes.merged_by_title(a, b, "title", False, "p_partkey").select("p_partkey", F.lit("keep").alias("mode")).unionByName(changes.merged_by_title(a, b, "title", True, "p_partkey").select("p_partkey", F.lit("force").alias("mode")))


def upsert_queries(spark, sf):
    o = table(spark, sf, "orders")
    stored = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    updates = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lower("o_orderstatus").alias("status"))
    return changes.upserted(stored, updates, "o_orderkey", ["status"], F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


def append_results(spark, sf):
    return changes.appended_once(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")), ["l_suppkey", "l_partkey"], "pos")


def insight_last_write(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.pmod("event_id", F.lit(5)).alias("index"), "ts", "event_id")
    return changes.last_write(e, ["user_id", "index"], "ts", "event_id").select("user_id", "index", "event_id")


def usage_counts(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.max(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("last_at"))
    return e.withColumn("calls", F.col("hits") + 1)


def insert_if_absent(spark, sf):
    p = table(spark, sf, "part").select("p_type", "p_partkey")
    return documents.insert_absent(p.where("p_partkey % 50 = 0"), p.where("p_partkey % 50 = 1"), "p_type")


def cases_to_documents(spark, sf):
    """Cases (orders) refer to documents (parts) by line items: per document its best case score and how many cases."""
    refs = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return refs.groupBy("l_partkey").agg(F.round(F.least(F.lit(1.0), F.max(F.col("o_totalprice") / 500000.0)), 6).alias("score"), F.count_distinct("o_orderkey").alias("cases"))


def enriched_results(spark, sf):
    """Cached results by id, else by title."""
    res = table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("rid"), F.col("p_type").alias("rtitle"), F.col("p_partkey").alias("ord"))
    docs = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    titles = docs.groupBy("p_type").agg(F.min_by("p_brand", "p_partkey").alias("by_title"))
    j = res.join(docs.select(F.col("p_partkey").alias("rid"), F.col("p_brand").alias("by_id")), "rid", "left").join(titles, F.col("rtitle") == F.col("p_type"), "left")
    return j.select("ord", F.coalesce("by_id", "by_title").alias("brand"))


def sampled_negatives(spark, sf):
    """Three per group, by a multiplicative hash that any engine can compute."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.pmod(F.col("p_partkey") * 7919, F.lit(10007)).alias("h"))
    w = Window.partitionBy("p_brand").orderBy("h", "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 3").select("p_brand", "p_partkey")


def pii_scrub(spark, sf):
    return _docs(spark, sf).select("doc_id", text.scrub_personal(F.col("text")).alias("scrubbed"))


def clean_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(text.clean_text(F.col("html"))).cast("long").alias("chars"))


def html_main_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("main"))


def numbering_normalise(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.clause_numbers(F.concat(F.lit("(a) "), "p_name", F.lit(" (c)"))).alias("numbered"), text.first_number(F.col("p_brand")).alias("number"), text.citation_prefix(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_partkey").cast("string")).alias("citation"))


def ref_extract(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("see "), F.col("p_size"), F.lit(" CFR "), F.col("p_partkey"), F.lit(".4(a) and 8 CFR 216.4(b), "), F.col("p_size"), F.lit(" CFR "), F.col("p_partkey"), F.lit(".4")).alias("t"))
    return p.select("p_partkey", F.array_join(text.regulation_references(F.col("t")), "; ").alias("refs"))


def summary_cleanup(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("I'm sorry, "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Summary: `"), "p_name", F.lit("` "))).otherwise(F.col("p_name")).alias("t"))
    return p.select("p_partkey", text.clean_summary(text.unless_refused(F.col("t"))).alias("summary"))


def page_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.page_date(F.col("o_orderdate").cast("string")).alias("shown"))


def rolling_rate(spark, sf):
    """Calls in the 60 seconds up to each call."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.count(F.lit(1)).over(w).alias("in_window"))


def ttl_cache_hits(spark, sf):
    """An entry is fresh for 300 s after the call before of the same key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    return e.select("event_id", F.coalesce(gap <= 300_000_000, F.lit(False)).alias("hit"))


def moderation_gate(spark, sf):
    """Unsafe documents go; unlabelled ones pass."""
    return _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").where("coalesce(toxic, 0) = 0").select("doc_id", "lang")


_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _tok(x: str) -> str:
    return _TOK.format(x)


def _strip(x: str) -> str:
    return _STRIP.format(x)


_PAIRS = f"""q AS (SELECT item_id AS query_id, {_tok('text')} AS q FROM benchmark WHERE item_id % {EVERY} = 0),
 d AS (SELECT doc_id, source, {_tok("split_part(text, chr(10), 1)")} AS title, {_tok('text')} AS d FROM documents),
 p AS (SELECT query_id, doc_id, q, title, d FROM d, q WHERE list_has_any(q, d))"""
_BM25 = "CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE list_sum(list_transform(q, lambda t: (len(list_filter(d, lambda x: x = t)) * 2.5::DOUBLE) / (len(list_filter(d, lambda x: x = t)) + 1.5::DOUBLE * (0.25 + 0.75 * len(d) / 2000.0::DOUBLE)))) END"
_JAC = "CASE WHEN len(q) = 0 OR len(title) = 0 THEN 0 ELSE len(list_intersect(q, title)) / len(list_distinct(q || title))::DOUBLE END"
_COV = "CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, d)) / len(list_distinct(q))::DOUBLE END"
_ANSWER = """a AS (SELECT event_id, event_id % 7 AS k, ((CAST(floor(value) AS BIGINT) % 14) + 14) % 14 - 3 AS v, round((event_id % 100) / 100.0::DOUBLE, 2) AS base FROM events),
 s AS (SELECT event_id, base, CAST(CASE WHEN k <= 3 THEN greatest(0, least(9, v)) WHEN k = 4 THEN greatest(0, least(9, v)) WHEN k = 5 THEN 1 END AS INT) AS score FROM a)"""
_STOP_SQL = "['" + "', '".join(lexicon.STOP_WORDS) + "']"
_HTML = "html"
for _pattern, _by in ((r"(?s)<!--.*?-->", " "), *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in ("script", "style", "nav", "header", "footer", "aside", "noscript")), (r"<[^>]*>", " ")):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_by}', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"
_PII = "text"
for _pattern in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"(?:\+?[0-9]{1,2}[ .-])?\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", r"(?i)\b(?:name|dob|ssn|passport|a-number)\s*:\s*[^\s,;]+"):
    _PII = f"regexp_replace({_PII}, '{_pattern}', '', 'g')"

ORACLE_SQL = {
    "doc_tokens_stats": f"SELECT doc_id, len({_tok('text')}) AS n_tokens, len(list_distinct({_tok('text')})) AS n_distinct, round(ln(1 + length(text)), 6) AS log_length FROM documents",
    "title_jaccard": f"WITH {_PAIRS} SELECT query_id, doc_id, round({_JAC}, 6) AS jaccard FROM p",
    "term_coverage": f"WITH {_PAIRS} SELECT query_id, doc_id, round({_COV}, 6) AS coverage FROM p",
    "bm25_score": f"WITH {_PAIRS} SELECT query_id, doc_id, round({_BM25}, 6) AS score FROM p",
    "features": f"WITH {_PAIRS}, b AS (SELECT *, {_BM25} AS bm FROM p) SELECT query_id, doc_id, round(bm, 6) AS bm25, round({_JAC}, 6) AS title_jaccard, round({_COV}, 6) AS coverage, round(ln(1 + len(d)), 6) AS log_tokens, round(max(bm) OVER (PARTITION BY query_id) - bm, 6) AS gap_from_top, len(list_distinct(q)) AS query_terms FROM b",
    "fulltext_search": f"""WITH f AS (SELECT doc_id, unnest({_tok("split_part(text, chr(10), 1)")}) AS token, 3.0::DOUBLE AS w FROM documents UNION ALL SELECT doc_id, unnest({_tok('text')}), 0.5 FROM documents),
        c AS (SELECT doc_id, token, sum(w) AS w FROM f GROUP BY ALL), q AS (SELECT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS token FROM benchmark WHERE item_id % {EVERY} = 0),
        s AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM c JOIN q USING (token) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM s) WHERE ord <= 10""",
    "keyword_matches": f"""WITH t AS (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:2], ' ') AS term FROM part),
        r AS (SELECT term, ' ' || array_to_string({_tok('term')}, ' ') || ' ' AS run FROM t), q AS (SELECT p_partkey AS query_id, ' ' || array_to_string({_tok('p_name')}, ' ') || ' ' AS x FROM part)
        SELECT DISTINCT query_id, term FROM q, r WHERE contains(x, run) AND run <> '  '""",
    "match_kinds": f"SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN 2 WHEN contains(lower(p_name), lower(p_type)) OR contains(lower(p_type), lower(p_name)) OR list_has_any({_tok('p_name')}, {_tok('p_type')}) THEN 1 ELSE 0 END AS by_type, 2 AS by_brand FROM part",
    "alias_pairs": "SELECT DISTINCT lower(trim(p_brand)) AS title, lower(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_brand) END)) AS alias FROM part WHERE lower(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_brand) END)) <> lower(trim(p_brand))",
    "dictionary_scan": "SELECT p_brand, count(DISTINCT p_size) AS n, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sections FROM part GROUP BY 1",
    "clean_queries": f"SELECT item_id AS query_id, array_to_string(list_filter({_tok('text')}, lambda w: NOT list_contains({_STOP_SQL}, w)), ' ') AS cleaned, regexp_replace(lower({_strip('text')}), '\\s+', ' ', 'g') AS normalised, array_to_string(regexp_split_to_array({_strip('text')}, '\\s+')[1:5], ' ') AS short FROM benchmark",
    "amendment_titles": "SELECT c_custkey, c_custkey || (CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END) || ' Amendment Section ' || c_nationkey AS title FROM customer",
    "articles_and_sections": "SELECT c_custkey, 'Article ' || ['" + "', '".join(text.to_roman(k) for k in range(1, 51)) + "'][c_nationkey + 1] AS article, CAST(c_custkey AS INT) AS section FROM customer",
    "ordinal_typos": "SELECT c_custkey, c_custkey || (CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END) || ' item' AS fixed FROM customer",
    "score_parse": f"WITH {_ANSWER} SELECT event_id, score FROM s",
    "score_adjust": f"WITH {_ANSWER} SELECT event_id, round(CASE WHEN score IS NULL THEN base ELSE least(base * (0.5::DOUBLE + score / 9.0::DOUBLE), 1.0::DOUBLE) END, 6) AS adjusted FROM s",
    "rephrase_chain": """WITH RECURSIVE n AS (SELECT c_custkey AS query, c_custkey % 7 = 0 AS r, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_custkey - 2 ELSE c_custkey + 1 END AS nx FROM customer),
        w AS (SELECT query, query AS final, [query] AS chain, 0 AS hops FROM n UNION ALL SELECT w.query, n.nx, list_append(chain, n.nx), hops + 1 FROM w JOIN n ON n.query = w.final WHERE NOT n.r AND n.nx IS NOT NULL AND NOT list_contains(chain, n.nx) AND hops < 3),
        e AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hops DESC) AS k FROM w)
        SELECT e.query, final, array_to_string(chain, '>') AS chain, CAST(hops AS INT) AS hops, coalesce(n.r, false) AS hit, coalesce(NOT n.r AND list_contains(chain, n.nx), false) AS loop_detected, coalesce(NOT n.r AND NOT list_contains(chain, n.nx) AND hops >= 3, false) AS hit_max_hops
        FROM e LEFT JOIN n ON n.query = e.final WHERE k = 1""",
    "ancestors_path": """SELECT 'r' || r_regionkey AS id, '' AS path, 0::BIGINT AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
        UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey || ' / n' || n_nationkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "ingest_enrich": """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS content, r_name || ' / ' || n_name AS path, r_name || ' ' || n_name AS h FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT id, title, content, 2 AS depth, path, concat_ws(' ', nullif(title, ''), h, nullif(content, '')) AS embed_text, CASE WHEN title = '' AND content = '' THEN 'skipped' ELSE 'ok' END AS status FROM c""",
    "ingest_summary": "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "children_wrap": """WITH k AS (SELECT l_orderkey, count(*) AS n, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS t FROM lineitem GROUP BY 1)
        SELECT o_orderkey, coalesce(n, 1) AS n, coalesce(t, o_orderstatus) AS first_title FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""",
    "full_texts": """WITH k AS (SELECT l_orderkey, string_agg(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), ' ' ORDER BY l_linenumber, l_returnflag, l_shipdate) AS t FROM lineitem GROUP BY 1)
        SELECT o_orderkey, concat_ws(' ', o_orderpriority, t) AS full_text FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""",
    "sections_grouped": "SELECT l_suppkey, l_returnflag, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_partkey))[1:5], ',') AS first_parts FROM lineitem GROUP BY 1, 2",
    "dup_titles": "SELECT lower(trim(split_part(text, chr(10), 1))) AS title, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "dup_composite": "SELECT lang, n, first_id FROM (SELECT text, lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1)",
    "dup_pattern": "SELECT p_brand, n, keys, CASE WHEN keys = 1 THEN 'true_duplicate' ELSE 'same_title' END AS pattern FROM (SELECT p_brand, count(*) AS n, count(DISTINCT (p_type, p_size)) AS keys FROM part GROUP BY 1 HAVING count(*) > 1)",
    "dedupe_newest": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "empty_text_docs": f"SELECT conv_id, turn FROM conversations WHERE turn % 4 = 0 OR coalesce({_strip('text')}, '') = ''",
    "collection_stats": "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (length(text) > 1000) AS long, count(*) FILTER (contains(text, chr(10))) AS multi_line, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents",
    "embedding_coverage": "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 9 <> 0) AS embedded, round(count(*) FILTER (vec_id % 9 <> 0) / count(*)::DOUBLE, 6) AS share FROM embeddings GROUP BY 1",
    "progress_by_group": "SELECT p_brand, count(*) AS n, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number FROM part GROUP BY 1",
    "dataset_statistics": "SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "top_by_children": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 20",
    "children_sequential": "SELECT l_orderkey, l_linenumber, expected FROM (SELECT l_orderkey, l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected FROM lineitem WHERE l_partkey % 10 <> 0) WHERE l_linenumber <> expected",
    "dup_children": "SELECT conv_id, n FROM (SELECT conv_id, substring(text, 1, 100), count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2 HAVING count(*) > 1)",
    "renumbered": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn::VARCHAR) AS INT) AS number FROM conversations",
    "heading_carry": "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN 'H' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current_heading FROM conversations",
    "clause_merge": "WITH i AS (SELECT *, greatest(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 1)::BIGINT AS clause FROM conversations) SELECT conv_id, clause, length(string_agg(text, ' ' ORDER BY turn, text)) AS chars FROM i GROUP BY 1, 2",
    "change_diff": f"""WITH o AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, {_strip("CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE ' ' || text END")} AS t FROM documents WHERE doc_id % 7 <> 0)
        SELECT doc_id, CASE WHEN o.t IS NULL THEN 'new' WHEN n.t IS NULL THEN 'deleted' WHEN o.t <> n.t THEN 'updated' ELSE 'same' END AS change FROM o FULL JOIN n USING (doc_id)""",
    "change_apply": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0",
    "new_removed_existing": "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'removed' ELSE 'existing' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id",
    "merge_precedence": """WITH r AS (SELECT p_partkey, lower(trim(p_type)) AS k, p_partkey % 2 AS odd FROM part)
        SELECT p_partkey, 'keep' AS mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY odd DESC, p_partkey) AS n FROM r) WHERE n = 1
        UNION ALL SELECT p_partkey, 'force' FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY odd, p_partkey) AS n FROM r) WHERE n = 1""",
    "upsert_queries": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE TIMESTAMP '2030-01-01' END AS created_at,
        CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS updated_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0""",
    "append_results": "SELECT l_suppkey, l_partkey, l_orderkey, pos FROM (SELECT *, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "insight_last_write": "SELECT user_id, index, event_id FROM (SELECT user_id, event_id % 5 AS index, event_id, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "usage_counts": "SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_at, count(*) FILTER (event_type = 'view') + 1 AS calls FROM events GROUP BY 1",
    "insert_if_absent": "SELECT p_type, p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_type NOT IN (SELECT p_type FROM part WHERE p_partkey % 50 = 1)",
    "cases_to_documents": "SELECT l_partkey, round(least(1.0::DOUBLE, max(o_totalprice / 500000.0::DOUBLE)), 6) AS score, count(DISTINCT o_orderkey) AS cases FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "enriched_results": """WITH r AS (SELECT p_partkey * 2 AS rid, p_type AS rtitle, p_partkey AS ord FROM part), d AS (SELECT * FROM part), t AS (SELECT p_type, arg_min(p_brand, p_partkey) AS b FROM d GROUP BY 1)
        SELECT ord, coalesce(d.p_brand, t.b) AS brand FROM r LEFT JOIN d ON rid = d.p_partkey LEFT JOIN t ON rtitle = t.p_type""",
    "sampled_negatives": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 7919) % 10007, p_partkey) AS n FROM part) WHERE n <= 3",
    "pii_scrub": f"SELECT doc_id, trim(regexp_replace({_PII}, '[ \\t]{{2,}}', ' ', 'g')) AS scrubbed FROM documents",
    "html_main_text": f"SELECT page_id, trim(regexp_replace({_HTML}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS main FROM pages",
    "numbering_normalise": "SELECT p_partkey, '(1) ' || p_name || ' (3)' AS numbered, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number, concat_ws(' ', 'Title ' || p_size, CASE WHEN p_size % 2 = 0 THEN 'Chapter ' || p_brand END, 'Section ' || p_partkey) AS citation FROM part",
    "ref_extract": "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size || ' CFR ' || p_partkey || '.4', '8 CFR 216.4'])), '; ') AS refs FROM part",
    "summary_cleanup": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS summary FROM part",
    "page_dates": "SELECT o_orderkey, 'Last Updated:' || strftime(o_orderdate, '%m/%d/%Y') AS shown FROM orders",
    "rolling_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "ttl_cache_hits": "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 300000000, false) AS hit FROM events",
    "moderation_gate": "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0",
}
_NO_SQL = ("clause_split", "clean_texts")
QUERIES = {name: globals()[name] for name in (*ORACLE_SQL, *_NO_SQL)}
