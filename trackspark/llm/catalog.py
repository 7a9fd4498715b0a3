"""Queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trackspark.llm import chat_format, embeddings, filter_audit, language_model, mixing, packing, personal_data, quality_rules, simhash, token_ids, url_filter, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_chat_format": chat_format.query,
    "op2_embedding_forest": embeddings.query,
    "op3_simhash_gray": simhash.query,
    "op4_best_fit_packing": packing.query,
    "op5_language_model": language_model.query,
    "op6_quality_rules": quality_rules.query,
    "op7_url_filter": url_filter.query,
    "op8_mixing": mixing.query,
    "op9_warc": warc.query,
    "op10_token_ids": token_ids.query,
    "op11_whitening": whitening.query,
    "op12_filter_audit": filter_audit.query,
    "op13_personal_data": personal_data.query,
}


def _with_package(query: Query) -> Query:
    """A local session's Python workers find the package where the driver did; clusters get it by ``--py-files``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        if sc.master.startswith("local"):
            sc.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return query(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: _with_package(q) for name, q in (_QUERIES | {"pipeline": _pipeline}).items()}


_CHAT = r"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- 4 + 2 + 9 characters of marks, and a backslash for each backslash and control string.
  CAST(sum(15 + length(replace(replace(role, '\', '\\'), chr(10), '\n'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

_WARC = """SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages)"""

_AUDIT = r"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
failed AS (SELECT doc_id, part, (len(w) < 100)::INT AS a, (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
    (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM words),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY ALL),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT f1.name || f2.name || f3.name || f4.name || f5.name AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31), -- five powers of two: each once
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS s(step))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM masks, steps GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose every result column it can say; the others are tested against brute force."""
    return {"op1_chat_format": _CHAT, "op9_warc": _WARC, "op12_filter_audit": _AUDIT}
