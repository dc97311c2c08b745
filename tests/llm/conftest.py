import os

import pytest
from pyspark.sql import types as T

#: As in the conftest above, whose name this one takes when all tests are collected.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Columns that operators might want for themselves.
CLASHES = ["id", "of", "score", "label", "size", "copies", "kept", "same", "bucket", "row"]


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, odd columns."""
    prose = " ".join(f"word{i % 97} and more{i % 13}" for i in range(120))
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (3, None, None, None), (4, "", "de", "b"),
        (5, " \n\t ", None, "b"), (6, "One two", "fr", None), (6, "One two", "fr", None),
        (7, "x " * 60000 + prose, "en", "a"), (8, "ü" * 70000, "de", "c"),
        (9, "*** ### $$$ " * 40, "es", "c"), (10, "1 2 3 !", "en", "c"),
        (11, prose.replace("word5 ", "other "), "en", "a"), (12, "line a\nline a\nline b", "fr", "b"),
        (13, "<|endoftext|> it's  two   spaces\r\n end ", "en", "é"),
    ]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES]])
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema)


@pytest.fixture(scope="session")
def nameless(spark, awkward):
    """A row without an id, beside the others."""
    row = spark.createDataFrame([(None, "nobody wrote this", "en", "a", *CLASHES)],
                                awkward.schema)
    return awkward.unionByName(row)


@pytest.fixture(scope="session")
def tables(spark, awkward, tmp_path_factory):
    """The awkward documents with labels, as a table folder; the tables have more columns."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    awkward.write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, 0), (4, 1, 0), (7, 0, 0), (9, 0, 1), (6, 1, 1), (11, 1, 0),
              (99, 0, 1), (None, 1, 1), (12, None, None), (10, 1, 0), (10, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int") \
        .write.parquet(f"{folder}/labels.parquet")
    vectors = [(0, [0.5, -0.25]), (50, [0.5, 0.5]), (51, None), (None, [1.0, 1.0]),
               (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, [0.5, 0.5]), (55, []),
               (100, [float("inf"), 0.0]), (56, [0.001, -0.001]), (57, [0.5, 0.5, 0.5])]
    labelled = [(*v, None if i == 4 else i % 2) for i, v in enumerate(vectors)]
    spark.createDataFrame(labelled, "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_tables(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(
            f"{folder}/{name}.parquet")
    return folder
