"""The thin op queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from ledgerloom.llm import byte_bpe, divergence, exact_dedup, hard_negatives, html_extract, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, simhash, substring_dedup, warc
from ledgerloom.llm._store import materialize, new_path
from ledgerloom.sources.tables import read


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality_rules.quality_rules(docs, read(spark, sf_dir, "labels"))
    return q.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("runs").cast("long").alias("n_runs"), longest.cast("long").alias("longest_run"))


OP3_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, line, string_split(text, chr(10))[line] AS body
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM lines WHERE regexp_matches(body, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT *, lead(body) OVER (PARTITION BY doc_id ORDER BY seq) AS follow FROM worded
), placed AS (
  SELECT doc_id, seq, body, follow, first_value(struct_pack(d := doc_id, s := seq)) OVER (PARTITION BY body ORDER BY doc_id, seq) AS first1,
    first_value(struct_pack(d := doc_id, s := seq)) OVER (PARTITION BY body, follow ORDER BY doc_id, seq) AS first2 FROM pairs
), openings AS (
  SELECT doc_id, seq, first2.d AS td, first2.s AS tseq FROM placed WHERE follow IS NOT NULL AND (doc_id <> first2.d OR seq - first2.s >= 2)
  UNION
  SELECT doc_id, seq, first1.d, first1.s FROM placed WHERE len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 50 AND (doc_id, seq) <> (first1.d, first1.s)
), heads AS (
  SELECT * FROM openings o WHERE NOT EXISTS (SELECT 1 FROM openings b WHERE b.doc_id = o.doc_id AND b.seq = o.seq - 1 AND b.td = o.td AND b.tseq = o.tseq - 1)
), grown AS (
  SELECT doc_id, seq, td, tseq, 1 AS length FROM heads
  UNION ALL
  SELECT g.doc_id, g.seq, g.td, g.tseq, g.length + 1 FROM grown g JOIN worded a ON a.doc_id = g.doc_id AND a.seq = g.seq + g.length JOIN worded b ON b.doc_id = g.td AND b.seq = g.tseq + g.length WHERE a.body = b.body
), found AS (
  SELECT doc_id, seq, td, tseq, max(length) AS length FROM grown GROUP BY ALL
), gone AS (
  SELECT DISTINCT w.doc_id, w.line FROM found f JOIN worded w ON w.doc_id = f.doc_id AND w.seq BETWEEN f.seq AND f.seq + f.length - 1
), kept AS (
  SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(w.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(r.n, 0) AS n_runs, cast(coalesce(r.longest, 0) AS bigint) AS longest_run
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id) w ON d.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, max(length) AS longest FROM found GROUP BY doc_id) r ON d.doc_id = r.doc_id
LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_dedup(docs, k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize(simhash.with_next(read(spark, sf_dir, "documents")), "simhash-made")
    return simhash.with_links(made).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_links")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    back = warc.resolved(materialize(warc.read_archives(spark, path, with_payload=False), "warc-index"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digest(byte_bpe.byte_bpe(docs, ranks, public_tokenizers.PATTERN))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", relabelled), anchor=F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_inner_product(a.vec, b.vec) AS bigint) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_files(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), tokens AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), vocabulary AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT g.lang, g.source, v.term, v.total, count(t.term) AS n FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN tokens t ON t.lang = g.lang AND t.source = g.source AND t.term = v.term GROUP BY ALL
), shares AS (
  SELECT *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::hugeint * (total + 1)) // (sum(total) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q FROM counted
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(value, 0) AS bigint) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, cast(((p - q) * (p - q)) // q AS bigint) FROM shares WHERE n > 0 AND p > q
)
SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank FROM parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


def token_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, the number of ids and the digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_html_extract": op8_html_extract,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
