"""The operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.llm import mixing, near_dedup, packing, quality, toxicity
from fieldgauge.llm.queries import DECISION, table
from fieldgauge.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below the decision, learnt from all labelled rows of the input."""
    labels = table(prepare(spark), sf_dir, "labels")
    scorer = toxicity.toxicity_scorer(docs, labels, F.lit(True))
    return toxicity.scored(docs, scorer, most=DECISION)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that reach the decision, learnt from all labelled rows of the input."""
    labels = table(prepare(spark), sf_dir, "labels")
    scorer = quality.quality_scorer(docs, labels, F.lit(True))
    return toxicity.scored(docs, scorer, least=DECISION)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that of the least id; rows without id stay.

    Of different texts under one kept id, the one with the least MD5 digest stays; rows that
    agree in id and text are one document. An empty table gives no rows.
    """
    prepare(spark)
    kept = near_dedup.near_classes(docs, with_digest=True) \
        .where("kept AND doc_id IS NOT NULL") \
        .groupBy(F.col("doc_id").alias("of")).agg(F.min("digest").alias("of_text"))
    named = docs.where(F.col("doc_id").isNotNull())
    digest = F.md5(F.coalesce(named["text"], F.lit("")).cast("binary"))
    return (named.join(kept, (named["doc_id"] == kept["of"]) & (digest == kept["of_text"]),
                       "left_semi")
            .dropDuplicates(["doc_id"])
            .unionByName(docs.where(F.col("doc_id").isNull())))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows without id stay once."""
    prepare(spark)
    copies = mixing.balanced_copies(docs.where(F.col("doc_id").isNotNull())) \
        .groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("mix_copies"))
    # The row travels as one column, whatever its columns are called.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))
    taken = rows.join(copies, F.col("key") == F.col("of")).where("mix_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
                        .alias("turn")).select("row.*") \
        .unionByName(docs.where(F.col("doc_id").isNull()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and their places in sequences of 1024 tokens."""
    prepare(spark)
    return packing.packed(docs)
