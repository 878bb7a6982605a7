"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


from pagegrid.llm import (
    bpe,
    exact_dedup,
    language,
    merkle,
    order_minhash,
    packing,
    pii,
    secret_scan,
    simhash,
    substring_dedup,
    token_spans,
    toxicity,
    warc,
)
from pagegrid.llm.common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of the queries; the operators take any path.
TOKENIZER = "word_bpe_49k.json"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once, unless their path has it already."""
    context = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="pagegrid-package-")
    base = os.path.join(folder, f"pagegrid-{uuid.uuid4().hex}")
    context.addPyFile(shutil.make_archive(base, "zip", ROOT, "pagegrid"))
    _shipped.add(context.applicationId)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def _token_spans(docs: DataFrame) -> DataFrame:
    return token_spans.linked_tokens(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read all records back; payloads are checked against their digests."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path, payload="check").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": _documents(exact_dedup.exact_duplicates),
        "op2_personal_data": _documents(pii.personal_report),
        "op3_secrets": _documents(secret_scan.secret_report),
        "op4_toxicity": _toxicity,
        "op5_simhash": _documents(simhash.near_duplicates),
        "op6_packing": _documents(lambda docs: packing.pack(docs, tokenizer())),
        "op7_order_minhash": _documents(order_minhash.fingerprints),
        "op8_language": _documents(language.predict_language),
        "op9_warc": _warc,
        "op10_bpe": _documents(lambda docs: bpe.token_digests(docs, tokenizer())),
        "op11_suffix_array": _documents(substring_dedup.removal_report),
        "op12_merkle": _documents(merkle.verified_manifest),
        "op13_token_spans": _documents(_token_spans),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries whose every column SQL can give."""
    return {
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
            FROM d WINDOW same AS (PARTITION BY t)
        """,
        "op9_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
            b AS (SELECT page_id, first_id, strlen(h) AS n,
                         CAST(unhex(sha1(h)) AS BIT)::VARCHAR AS bits FROM f)
            SELECT page_id, n AS payload_bytes,
                   list_aggregate(list_transform(range(32), lambda k: substr(
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + list_sum(list_transform(range(5), lambda i:
                           CAST(substr(bits, 5 * k + i + 1, 1) AS INT) * CAST(pow(2, 4 - i) AS INT)
                       ))::INT, 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM b
        """,
        "op12_merkle": """
            WITH RECURSIVE d AS (
                SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, n_chars,
                       list_transform([source, lang], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f,
                       coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS i,
                       coalesce(strlen(text) || ':' || text, '-') AS t,
                       coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS c,
                       coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS c1,
                       list_reduce(list_transform(range(1, 1 + strlen(doc_id::VARCHAR)),
                               lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
                           lambda crc, b: list_reduce(range(8),
                               lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)),
                           4294967295::BIGINT) AS crc
                FROM documents),
            leaves AS (
                SELECT doc_id, g, sha256(i || f[1] || f[2] || c || t) AS leaf,
                       CASE WHEN xor(crc, 4294967295) % 7 = 0
                            THEN sha256(i || f[1] || f[2] || c1 || t) END AS changed
                FROM d),
            base AS (
                SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                       count(*) OVER (PARTITION BY g) AS n
                FROM leaves),
            up AS (
                SELECT g, 0 AS lvl, pos, n, leaf AS h FROM base
                UNION ALL
                SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
                FROM up WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
            tops AS (
                SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
                FROM up WHERE n = 1),
            upper AS (
                SELECT 0 AS lvl, pos, n, h FROM tops
                UNION ALL
                SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
                FROM upper WHERE n > 1 GROUP BY lvl, pos // 2, n),
            steps AS (
                SELECT b.g, b.pos, l.lvl, 0 AS tier, b.pos >> l.lvl AS own
                FROM base b JOIN (SELECT DISTINCT g, lvl FROM up WHERE n > 1) l ON l.g = b.g
                UNION ALL
                SELECT b.g, b.pos, l.lvl, 1, t.pos >> l.lvl
                FROM base b JOIN tops t ON t.g = b.g, (SELECT DISTINCT lvl FROM upper WHERE n > 1) l),
            paths AS (
                SELECT s.g, s.pos, list({'first': s.own % 2 = 0, 'h': coalesce(u.h, v.h, '')}
                                       ORDER BY s.tier, s.lvl) AS path
                FROM steps s
                LEFT JOIN up u ON s.tier = 0 AND u.g = s.g AND u.lvl = s.lvl AND u.pos = xor(s.own, 1)
                LEFT JOIN upper v ON s.tier = 1 AND v.lvl = s.lvl AND v.pos = xor(s.own, 1)
                GROUP BY s.g, s.pos),
            folded AS (
                SELECT b.doc_id, b.leaf, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
                       sha256(coalesce(list_aggregate(list_transform(p.path, lambda x: x.h),
                                                      'string_agg', ''), '')) AS proof_sha256,
                       list_reduce(list_prepend(coalesce(b.changed, b.leaf), list_transform(
                               coalesce(p.path, []), lambda x: CASE WHEN x.first THEN '>' ELSE '<' END || x.h)),
                           lambda h, x: sha256(CASE WHEN x[1] = '>' THEN h || x[2:] ELSE x[2:] || h END)
                       ) AS folded_root
                FROM base b JOIN tops t ON t.g = b.g LEFT JOIN paths p ON p.g = b.g AND p.pos = b.pos)
            SELECT *, folded_root = root AS verified FROM folded
        """,
    }
