"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontaminate, fingerprints, licenses, neardup, packing, secret_scan, substrings, toxicity, warc, wrapper


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_warc": warc.query,
        "op3_decontamination": decontaminate.query,
        "op4_secrets": secret_scan.query,
        "op5_fingerprints": fingerprints.query,
        "op6_main_text": wrapper.query,
        "op7_repeated_substrings": substrings.query,
        "op8_packing": packing.query,
        "op9_licenses": licenses.query,
        "op10_near_duplicates": neardup.query,
        "pipeline": pipeline,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op3_decontamination": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[CAST(i AS INT):CAST(i + 9 AS INT)], ' ') AS body, least(len(w), 10) AS n
                    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM windows),
        spots AS (SELECT doc_id, i, n, array_to_string(w[CAST(i AS INT):CAST(i + n - 1 AS INT)], ' ') AS body
                  FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
        hits AS (SELECT doc_id, i, spots.n AS n, item_id FROM spots JOIN windows USING (body) WHERE windows.n = spots.n),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS INT):CAST(i + 3 AS INT)], ' ') AS sh
              FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM common JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 80 * (cx.n + cy.n - k)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        reach AS (SELECT x AS node, x AS seen FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.seen),
        least_seen AS (SELECT node, min(seen) AS m FROM reach GROUP BY node)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN least_seen ON node = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
