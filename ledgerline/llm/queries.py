"""The corpus operators over the whole test tables, as named queries, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    collision_ann, langid, license_scan, metric_tree, mixing, ngram_join, packing, rabitq_dedup, sharding, suffix_dedup, token_align,
    token_files, whitening,
)
from ledgerline.llm.common import Scratch
from ledgerline.llm.tokens import tokenizer_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = Scratch(spark, "op1").root
    token_files.write_token_files(spark, documents(spark, sf_dir), target, path=tokenizer_path("word_bpe_49k.json"), end=2)
    return token_files.token_digests(token_files.read_token_files(spark, target, with_ids=False))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_documents(spark, documents(spark, sf_dir), width=3, percent=90)
    return linked.select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, documents(spark, sf_dir), n_shards=40)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, documents(spark, sf_dir), path=tokenizer_path("byte_bpe_50k.json"), end=0, size=1024, with_ids=False).drop("ids")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(spark, documents(spark, sf_dir)))


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(spark, embeddings(spark, sf_dir), "vec_id % 100 = 0", k=10)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(documents(spark, sf_dir))


def op8_rabitq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq_dedup.link_vectors(spark, embeddings(spark, sf_dir), threshold=0.95)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, documents(spark, sf_dir)).drop("doc_key", "source")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, documents(spark, sf_dir)).drop("_rest")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(spark, documents(spark, sf_dir), a="byte_bpe_50k.json", b="piece_bpe_32k.model", with_groups=False)


def op12_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_products(spark, embeddings(spark, sf_dir), where="vec_id % 20 = 0", k=20, factor=64)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = whitening.whiten(spark, embeddings(spark, sf_dir), k=8, factor=1024, offset=100_000)
    return told.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_ngram_join, op3_sharding, op4_packing, op5_suffix_dedup, op6_collision_ann, op7_language_id,
        op8_rabitq_dedup, op9_mixing, op10_license_scan, op11_token_alignment, op12_metric_tree,
        op13_whitening,
    )
}

#: The other queries have no SQL form that runs over whole tables; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    # Shingles are texts of three words; pairs meet on shingles they share, components by following links.
    "op2_ngram_join": r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) END AS s
  FROM cut
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
), numbered AS (SELECT row_number() OVER () AS k, * FROM classes
), shared AS (
  SELECT a.k AS x, b.k AS y, count(*) AS i
  FROM (SELECT k, n, unnest(s) AS t FROM numbered) a JOIN (SELECT k, n, unnest(s) AS t FROM numbered) b ON a.t = b.t AND a.k <> b.k
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN numbered a ON x = a.k JOIN numbered b ON y = b.k WHERE 100 * i >= 90 * (a.n + b.n - i)
), reach AS (
  SELECT k AS x, k AS y FROM numbered UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), named AS (SELECT x AS k, min(c) AS component_id FROM reach JOIN numbered ON y = k GROUP BY x)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, COALESCE(named.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN numbered ON list_sort(sets.s) = numbered.s LEFT JOIN named USING (k)""",
    # Distances and cosines in double precision; the search finds all of them on these tables.
    "op6_collision_ann": """
WITH good AS (
  SELECT vec_id, [c::DOUBLE for c in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c for c in embedding if c <> 0]) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum([(q.e[k] - c.e[k]) * (q.e[k] - c.e[k]) for k in range(1, len(q.e) + 1)])) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
WHERE rank <= 10""",
    "op8_rabitq_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, [c::DOUBLE for c in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c for c in embedding if c <> 0]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), named AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named""",
    # Products of whole numbers below 2^53 are exact as doubles.
    "op12_metric_tree": """
WITH whole AS (
  SELECT vec_id, [floor(64 * c::DOUBLE) for c in embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20""",
}
