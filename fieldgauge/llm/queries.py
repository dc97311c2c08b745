"""The operators over the driver tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.llm import alignment, domain_rules, hard_negatives, language, mixing, near_dedup, \
    packing, quality, simhash, topk, toxicity, wavelet, wordpiece
from fieldgauge.llm.common import in_fold
from fieldgauge.session import prepare, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)
    run.__doc__ = function.__doc__
    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document counts as of label 1 from this score on.
DECISION = 0.3


def _judged(docs: DataFrame, scorer, held_out) -> DataFrame:
    scores = toxicity.scored(docs.select("doc_id", "text"), scorer)
    return scores.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= DECISION).cast("int").alias("predicted"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from four folds of five."""
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 5, 0)
    scorer = quality.quality_scorer(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _judged(docs, scorer, held_out)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learnt from three folds of four."""
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 4, 2)
    scorer = toxicity.toxicity_scorer(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _judged(docs, scorer, held_out)


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query
def op4_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule figures and the target-domain verdict of every document."""
    return domain_rules.domain_verdicts(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.balanced_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the wavelet-matrix shards."""
    path = scratch_path(spark, "wavelet-shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path)
    return wavelet.documents_of(wavelet.read_shards(spark, path))


@query
def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer products of every 50th vector with the others."""
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.top_products(vectors, F.col("id") % 50 == 0, 5).select(
        F.col("query_id"), "rank", F.col("id").alias("vec_id"), "score")


_SQL["op6_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three folds of four."""
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 4, 2)
    scorer = language.language_scorer(docs, ~held_out)
    return language.languages_of(docs, scorer).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


@query
def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document's tokens line up between two tokenizers."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives below each positive of every 100th vector."""
    label = F.col("label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = hard_negatives.labelled(
        table(spark, sf_dir, "embeddings").withColumn("label", shifted), "vec_id", "label",
        "embedding", 256)
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
         CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negative AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                            ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM negative WHERE rank <= 5
"""
