"""The registered corpus queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm import bag_minhash, exact_dedup, fuzzy_lines, kd_means, language_id, lexicon_print, main_text, packing, periodic_runs, quality, toxicity, warc, word_bpe
from skylattice.runtime import prepare, shared_dir, table


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(prepare(spark), sf_dir, "pages"))


def op6_lexicon_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_print.fingerprints(table(prepare(spark), sf_dir, "documents"))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(prepare(spark), sf_dir, "documents"))


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_classes(table(prepare(spark), sf_dir, "documents"))


def op2_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(prepare(spark), sf_dir, "documents"))


def op3_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.report(table(prepare(spark), sf_dir, "documents"))


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digested(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digested(periodic_runs.periodic_runs(periodic_runs.with_planted(table(prepare(spark), sf_dir, "documents"))))


def op12_kd_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means.digested(kd_means.clusters(table(prepare(spark), sf_dir, "embeddings")))


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages in the shared folder, read back through their merged index. Pages have no time: a second an id from 2024 on stands for it."""
    path = f"{shared_dir(prepare(spark))}/skylattice/warc-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0)))
    warc.write_archives(table(spark, sf_dir, "pages"), path, at=at)
    found = warc.histories(runtime.written(warc.runs(spark, path), "captures"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash": op1_bag_minhash,
    "op2_bitmask_language_id": op2_bitmask_language_id,
    "op3_factorization_toxicity": op3_factorization_toxicity,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_tag_path_text": op5_tag_path_text,
    "op6_lexicon_fingerprints": op6_lexicon_fingerprints,
    "op7_attention_quality": op7_attention_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_forced_boundary_bpe": op10_forced_boundary_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_kd_filtering": op12_kd_filtering,
    "op13_warc_index": op13_warc_index,
}

def lloyd_sql(dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of op12: every vector against every centroid, a round after another."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS z, v AS c FROM v QUALIFY z < {k})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, min(row(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), z)) AS m
          FROM v, c{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT z, j, sum(x) AS s, count(*) AS n FROM (SELECT m[2] AS z, unnest(v) AS x, unnest(range({dim})) AS j FROM a{i}) GROUP BY ALL),
          n{i} AS MATERIALIZED (SELECT z, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY z),
          c{i + 1} AS MATERIALIZED (SELECT z, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (z))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(z AS INT) AS cluster, CAST(m[1] AS BIGINT) AS distance, CAST(sum(m[1]) OVER (PARTITION BY z) AS BIGINT) AS cluster_inertia,
          CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON z = m[2]"""


ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_kd_filtering": lloyd_sql(),
    "op13_warc_index": rf"""
        WITH t AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last,
            lower(regexp_extract(url, '^[A-Za-z0-9+.-]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z0-9+.-]+://[^/?#]*([^#]*)', 1) AS rest FROM pages),
          k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM t)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
          CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, url_key,
          row_number() OVER (ORDER BY url_key, page_id % 100000000, page_id) - 1 AS capture_no FROM k""",
}
