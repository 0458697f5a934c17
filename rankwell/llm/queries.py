"""The queries of the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_hash, stored
from .decontamination import contaminated_passages
from .exact_dedup import exact_duplicates
from .hmm import language_model_scores
from .language_id import identify_languages
from .license_scan import scan_licences
from .line_dedup import without_repeats
from .merkle import audited, folded, siblings_digest
from .ngram_join import ngram_components
from .packing import pack, word_lengths
from .prefix_trie import prefix_trie
from .sharding import interleaved
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = stored(word_lengths(documents(spark, sf_dir)), "lengths")
    return pack(lengths, id_col="id").withColumnRenamed("id", "doc_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(7)) == 2
    rows = language_model_scores(documents(spark, sf_dir), ~held_out)
    return rows.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), words=3, percent=90).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1
    rows = identify_languages(documents(spark, sf_dir), ~held_out, carry=["doc_id"])
    return rows.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleaved(documents(spark, sf_dir), shards=16)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = write_token_files(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(docs, files).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(documents(spark, sf_dir)).withColumn("folded_root", folded(F.col("forged"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(documents(spark, sf_dir), carry=["doc_id"])
    return rows.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

#: A-Z in normal form for SQL.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Levels that the manifest's SQL unrolls; further ones change nothing below 16 ** LEVELS rows a source or sources.
_LEVELS = 6


def _crc32(text: str) -> str:
    """crc32 of a short SQL text, unsigned; DuckDB has none."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: {bits}), 4294967295::UBIGINT)"


def _manifest_sql() -> str:
    def record(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {record("text")} AS leaf,
              CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {record(lowered)} ELSE {record("text")} END AS forged FROM documents)""",
        "own0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, leaf, forged FROM d)",
    ]

    def tree(name: str) -> None:
        for k in range(1, _LEVELS + 1):
            parts.append(f"""{name}{k} AS (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS run, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,
                n AS below, (n + 15) // 16 AS n FROM (SELECT g, pos, h, n FROM {name}{k - 1}) GROUP BY g, pos // 16, n)""")

    tree("own")
    parts.append(f"top0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS src FROM own{_LEVELS})")
    tree("top")
    parts.append("f0 AS (SELECT o.doc_id, o.g, o.pos, t.pos AS top_pos, o.leaf, '' AS siblings, o.forged AS h FROM own0 o JOIN top0 t ON t.src = o.g)")
    step = 0
    for name, at in (("own", "pos"), ("top", "top_pos")):
        on = "t.g = f.g" if name == "own" else "true"
        for k in range(1, _LEVELS + 1):
            step += 1
            i = f"(f.{at} % 16)"
            moved = "f.pos, f.top_pos // 16 AS top_pos" if name == "top" else "f.pos // 16 AS pos, f.top_pos"
            parts.append(f"""f{step} AS (SELECT f.doc_id, f.g, {moved}, f.leaf,
                CASE WHEN t.below = 1 THEN f.siblings ELSE f.siblings || array_to_string(t.run[1:{i}] || t.run[{i} + 2:], '') END AS siblings,
                CASE WHEN t.below = 1 THEN f.h ELSE sha256(array_to_string(t.run[1:{i}] || [f.h] || t.run[{i} + 2:], '')) END AS h
                FROM f{step - 1} f JOIN {name}{k} t ON {on} AND t.pos = f.{at} // 16)""")
    return f"""WITH {", ".join(parts)}
        SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM f{step} f JOIN own{_LEVELS} s ON s.g = f.g CROSS JOIN top{_LEVELS} r"""


_TRIE_SQL = f"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                          strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, '') AS said, length(coalesce(text, '')) AS size
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT c, c - c % 100 AS base, {_crc32("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
        r AS (SELECT c.c, t.pos, t.said, t.size FROM c JOIN t ON t.c = c.base WHERE t.pos < c.h
              UNION ALL SELECT c.c, t.pos + 1000000000, t.said, t.size FROM c JOIN t ON t.c = c.c WHERE t.pos >= c.h),
        s AS (SELECT c, row_number() OVER w AS depth, string_agg(said, '') OVER w AS prefix, size FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
        m AS (SELECT c, depth, sha256(prefix) AS prefix, size FROM s UNION ALL SELECT c, 0, '', 0 FROM c),
        l AS (SELECT c, max(depth) AS length FROM m GROUP BY c),
        g AS (SELECT *, min(c) OVER (PARTITION BY depth, prefix) AS node FROM m),
        n AS (SELECT g.node, g.depth, count(*) AS n_convs, max(g.size) AS size, min(p.node) AS parent,
                     sha256(coalesce(string_agg(CASE WHEN l.length = g.depth THEN g.c::VARCHAR END, ',' ORDER BY g.c), '')) AS ends_sha256
              FROM g JOIN l ON l.c = g.c LEFT JOIN g p ON p.c = g.c AND p.depth = g.depth - 1 GROUP BY g.node, g.depth),
        k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent, depth),
        x AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth)
        SELECT a.node AS conv_id, a.depth, any_value(a.parent) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children)::BIGINT AS n_children,
               count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
        FROM x b JOIN g ON g.c = b.node AND g.depth <= b.depth JOIN x a ON a.node = g.node AND a.depth = g.depth GROUP BY a.node, a.depth"""

_LINES_SQL = """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM d),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY place), '')) AS kept_sha256
        FROM f GROUP BY doc_id"""

ORACLE_SQL = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_merkle_manifest": _manifest_sql(),
    "op12_prefix_trie": _TRIE_SQL,
    "op13_line_dedup": _LINES_SQL,
}
