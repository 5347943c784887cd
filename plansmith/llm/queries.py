"""The registered queries of this subpackage and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .divergence import source_divergence
from .jaccard_join import jaccard_groups
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .lm_scoring import cross_entropy_difference
from .packing import pack_documents
from .quality_rules import quality_rules
from .sharding import shard_rows
from .token_alignment import align_tokens
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .trie_bpe import encode_documents
from .vector_files import exact_top_k


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back from them."""
    path = write_token_files(read_table(spark, sf_dir, "documents"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without fuzzily repeated lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs)
    return packed.select("doc_id", F.col("piece_start").alias("start"), F.col("piece_length").alias("length"), F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("seq_offset").alias("offset"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(slim, ["doc_id", "size", "text_crc32"], shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each document is like the documents labelled good."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), good)


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digest_only=True)


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_other", "byte_share", "token_entropy", "band")


def op8_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector."""
    rows = exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document."""
    out = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select("doc_id", F.size("matches").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_max(F.transform("matches", lambda m: m["coverage"])).alias("best_coverage"), F.get("matches", F.lit(0))["begin"].alias("first_begin"), F.get("matches", F.lit(0))["end"].alias("first_end"), "matches")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"), limit=1024)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their words."""
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups and links of two tokenizers' tokens in every document."""
    out = align_tokens(read_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans": op1_rans,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_fertility": op7_fertility,
    "op8_va_file": op8_va_file,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard": op10_jaccard,
    "op11_token_counts": op11_token_counts,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op8_va_file": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
        ), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
    """,
    "op12_divergence": """
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents
        ), t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS whole
            FROM totals g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), own AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - whole) * (p - whole) // whole AS BIGINT) AS value FROM shares WHERE n > 0 AND p > whole),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
