"""The numbered queries over the synthetic tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balltree, bpe, decontam, divergence, language, licenses, neardup, packing, secret_scan, sentences, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.neighbours(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.default_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.report(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.clusters(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"), bpe.default_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_license_scan, op3_minhash_near_dedup, op4_simhash, op5_decontamination, op6_toxicity, op7_secret_scan, op8_bpe_round_trip, op9_warc, op10_substring_dedup, op11_centroid_clustering, op12_source_divergence, op13_best_fit_packing)
}

def _clustering_sql(dims: int = 64, k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds in exact integers, a relation of (cluster, component) for each."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (j) GROUP BY v.vec_id, c.c),
            a{i} AS MATERIALIZED (SELECT vec_id, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT a.c, v.j, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id) GROUP BY a.c, v.j),
            c{i + 1} AS MATERIALIZED (SELECT c.c, c.j, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c, j))""")
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""
        WITH e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND {finite}),
            v AS MATERIALIZED (SELECT vec_id, unnest(generate_series(1, {dims})) AS j, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM e),
            s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < {k}),
            c0 AS MATERIALIZED (SELECT s.c, v.j, v.x FROM s JOIN v USING (vec_id)),
            {", ".join(steps)},
            h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
        FROM a{rounds} a JOIN h USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
             g AS (SELECT DISTINCT lang, source FROM d),
             k AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
             o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
             v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
             c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
             w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
             p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
             q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM w JOIN v USING (lang)),
             pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
             every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                       LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                       UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
             r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             r AS (SELECT html, max(page_id) AS response FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN r.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN r.response <> p.page_id THEN r.response END AS refers_to
        FROM p LEFT JOIN r ON p.html = r.html""",
}
