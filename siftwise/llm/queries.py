"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwise.llm import embeddings, merkle, mixing, packing, pii, quality, sharding, simhash, suffix, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.uniform_tree(40), added=40)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_embedding_dedup,
        op3_mixing,
        op4_sharding,
        op5_quality,
        op6_warc_audit,
        op7_suffix_dedup,
        op8_packing,
        op9_merkle_fingerprints,
        op10_pii,
    )
}

def _inverse_sql(done: str, schedule) -> str:
    """mixing.demand_inverse in SQL."""
    steps = len(schedule) - 1
    areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]
    total, at, cases = sum(areas), 0.0, []
    real = lambda x: f"CAST({x!r} AS DOUBLE)"
    for k, area in enumerate(areas):
        a, slope = schedule[k], (schedule[k + 1] - schedule[k]) * steps
        need = f"greatest({done} * {real(total)} - {real(at)}, {real(0.0)})"
        root = f"sqrt(greatest({real(a * a)} + {need} * {real(2 * slope)}, {real(0.0)}))"
        at += area
        cases.append(f"WHEN {done} * {real(total)} <= {real(at)} THEN least({real(k / steps)} + {need} * 2 / ({real(a)} + {root}), {real((k + 1) / steps)})")
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


def _position_sql(turn: int) -> str:
    done = f"((before_it + source_size * {turn}) / CAST(greatest(whole, 1) AS DOUBLE))"
    n = len(mixing.SCHEDULES)
    cases = " ".join(f"WHEN k % {n} = {i} THEN {_inverse_sql(done, s)}" for i, s in enumerate(mixing.SCHEDULES))
    return f"CASE WHEN piece{turn} > 0 THEN CASE {cases} END END"


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source
        ), w AS (
            SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
        ), r AS (
            SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
                sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w
        ), l AS (SELECT *, (total * 1.5::DOUBLE - capped) / open AS level FROM r),
        c AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1),
        t AS (SELECT l.*, coalesce(least(cap, (SELECT level FROM c) * weight), cap) AS target FROM l),
        p AS (
            SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.k, CAST(least(CAST(round(t.target) AS BIGINT), t.source_size * 2) AS BIGINT) AS whole,
                CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_it
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), q AS (
            SELECT *, greatest(least(whole - before_it, size), 0) AS piece0, greatest(least(whole - source_size - before_it, size), 0) AS piece1 FROM p
        )
        SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(piece0 + piece1 AS BIGINT) AS taken,
            {_position_sql(0)} AS position, {_position_sql(1)} AS repeat_position FROM q
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
              ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), r AS (
            SELECT vec_id AS node, vec_id AS found FROM embeddings
            UNION SELECT r.node, l.b FROM r JOIN l ON r.found = l.a
        ), c AS (SELECT node, min(found) AS component_id FROM r GROUP BY node),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a JOIN c ON e.vec_id = c.node
    """,
    "op6_warc_audit": """
        WITH r AS (
            SELECT page_id, page_id // 1000 AS file,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages
        )
        SELECT page_id, file, row_number() OVER w - 1 AS seq,
            CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
            strlen(record) AS record_length, sha256(record) AS digest,
            page_id % 101 = 7 OR page_id % 211 = 3 AS corrupt
        FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)
    """,
}
