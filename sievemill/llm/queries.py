"""The registered queries of this subpackage: each applies one operator to its whole table with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamming_search, html_wrapper, line_dedup, near_vectors, negatives, ngram_join, packing, quality_fm, sharding, token_counts, warc, whitening
from .common import materialise, table


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_fm.score_quality(docs, machine)
    return scored.select("doc_id", (quality_fm.fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = materialise(hamming_search.binary_codes(table(spark, sf_dir, "embeddings")), "codes")
    return hamming_search.top_k(codes, codes.filter(F.col("vec_id") % 20 == 0), k=10)


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable_rows(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


def op12_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_nn_descent_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93).drop("audited_recall")


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_bin_packing,
        op2_wrapper_induction,
        op3_rank_synchronous_counts,
        op4_prefix_tree_join,
        op5_gzip_normaliser,
        op6_cuckoo_line_dedup,
        op7_hierarchical_packing,
        op8_factorisation_machine,
        op9_greedy_string_tiling,
        op10_multi_index_hashing,
        op11_ball_tree_negatives,
        op12_digit_slice_whitening,
        op13_nn_descent_near_dedup,
    )
}

#: DuckDB SQL for the rows of those queries that SQL can express.
ORACLES = {
    "op5_gzip_normaliser": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN o.owner IS NULL OR o.owner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN o.owner <> p.page_id THEN o.owner END AS refers_to
        FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000""",
    "op6_cuckoo_line_dedup": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
                          unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM hot)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
    "op10_multi_index_hashing": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
                     CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
              FROM e AS q JOIN e AS r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
        SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= 10""",
    "op11_ball_tree_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS anchor_id, r.vec_id AS id, q.label = r.label AS same,
                     CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM e AS q JOIN e AS r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.x) = len(r.x)),
        p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER w <= 5""",
    "op13_nn_descent_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e AS a JOIN e AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
        c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id""",
}
