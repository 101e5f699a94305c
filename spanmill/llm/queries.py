"""Registered queries of the training-data operators, and SQL where it can check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanmill.llm.alignment import token_links
from spanmill.llm.centroids import CLUSTERS, DIMS, ROUNDS, SCALE, SEED, centroid_clusters
from spanmill.llm.common import documents
from spanmill.llm.fingerprints import edited_fingerprints
from spanmill.llm.language_id import predict_languages
from spanmill.llm.line_dedup import dedup_lines
from spanmill.llm.near_dedup import near_duplicates
from spanmill.llm.packing import pack_along_curve
from spanmill.llm.piece_bpe import piece_digests
from spanmill.llm.quality import quality_scores
from spanmill.llm.secret_scan import secret_report
from spanmill.llm.token_shards import token_shards
from spanmill.llm.topk_search import sign_codes, top_k
from spanmill.llm.word_bpe import word_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@query
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 50."""
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(codes, codes.filter("id % 50 = 0"), 10)


SQL["op10_topk_search"] = """
WITH vectors AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
    SELECT q.id AS query_id, c.id AS neighbor_id,
           CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.v[i] > 0) <> (c.v[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
    FROM vectors q, vectors c WHERE q.id % 50 = 0 AND q.id <> c.id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "copies", "class_key")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _centroid_sql() -> str:
    """The rounds one after the other; sums as whole numbers, means as their exact floor."""
    near = """SELECT rid, min_by(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM (
        SELECT v.rid, c.cluster, CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.comps[i] - c.comps[i]) * (v.comps[i] - c.comps[i]))) AS BIGINT) AS d
        FROM v, {c} c) GROUP BY rid"""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS comps FROM embeddings
            WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, comps) - 1 AS INTEGER) AS cluster, comps FROM (
            SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, comps FROM v WHERE vec_id IS NOT NULL ORDER BY h, comps LIMIT {CLUSTERS}))""",
    ]
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(dims=DIMS, c=f'c{r}')})")
        steps.append(f"""s{r} AS MATERIALIZED (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
            SELECT a.cluster, unnest(v.comps) AS x, unnest(range({DIMS})) AS i FROM a{r} a JOIN v USING (rid)) GROUP BY cluster, i)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.comps, c.comps) AS comps FROM c{r} c LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS comps FROM s{r} GROUP BY cluster) m USING (cluster))""")
    steps.append(f"last AS MATERIALIZED ({near.format(dims=DIMS, c=f'c{ROUNDS}')})")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT v.vec_id, a.cluster, a.distance,
        CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.comps, ',')) AS centroid_sha256
    FROM last a JOIN v USING (rid) JOIN c{ROUNDS} c USING (cluster)"""


SQL["op12_centroids"] = _centroid_sql()


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
