"""Queries over the given tables for the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import cross_tokenizer, decontaminate, exact_dedup, language_id, line_quality, mixing, near_dedup, pseudonyms, quality, substring_dedup, token_counts, vector_codes, web_archive
from colloquy.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read_table(spark, sf_dir, "documents"), keep="most")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archive_pages(read_table(spark, sf_dir, "pages")).drop("record_id", "date")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fixed key, so that runs over the given tables agree; with real data the key is a secret
    return pseudonyms.report(read_table(spark, sf_dir, "documents"), b"op7")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.report(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read_table(spark, sf_dir, "embeddings"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _codes_sql(rounds: int = 4) -> str:
    """Vector codes in SQL: one table of entries and one of nearest entries a round. All values are whole, so doubles are exact."""
    nearest = lambda k: f"""n{k} AS MATERIALIZED (SELECT x.vec_id, x.part, arg_min(e.entry, (d, e.entry)) AS entry, min(d) AS d
        FROM (SELECT x.vec_id, x.part, e.entry, list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, e.p) + list_inner_product(e.p, e.p) AS d FROM parts x JOIN e{k} e ON e.part = x.part) e JOIN parts x USING (vec_id, part) GROUP BY ALL)"""  # noqa: E731
    steps = [nearest(0)]
    for k in range(rounds):
        steps.append(f"""s{k + 1} AS (SELECT part, entry, place, floor(sum(v) / count(*)) AS v FROM (SELECT x.part, n.entry, unnest(x.p) AS v, generate_subscripts(x.p, 1) AS place FROM n{k} n JOIN parts x USING (vec_id, part)) GROUP BY ALL),
        e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.p, e.p) AS p FROM e{k} e LEFT JOIN (SELECT part, entry, list(v ORDER BY place) AS p FROM s{k + 1} GROUP BY ALL) m USING (part, entry))""")
        steps.append(nearest(k + 1))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS p FROM kept, (SELECT unnest([0, 1, 2, 3]) AS part)),
        e0 AS MATERIALIZED (SELECT part, entry, p FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id)),
        {", ".join(steps)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY 1),
        digest AS (SELECT sha256(string_agg(array_to_string(list_transform(p, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS s FROM e{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_quality, op4_token_counts, op5_substring_dedup, op6_warc, op7_pseudonyms, op8_mixing, op9_decontamination, op10_minhash, op11_token_alignment, op12_vector_codes, op13_line_quality)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
                 q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                              max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
            FROM q""",
        "op12_vector_codes": _codes_sql(),
    }
