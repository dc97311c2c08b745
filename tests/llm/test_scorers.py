"""Classifiers on held-out rows, and their parts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import common, language, quality, queries as q, toxicity

SF = "/root/testdata/sf0.1"


def outcome(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.queries()[name](spark, SF).where("held_out").join(labels, "doc_id").collect()
    return [(r[label], r.predicted) for r in rows]


def test_quality_held_out(spark):
    rows = outcome(spark, "op1_quality", "quality")
    good = [p for y, p in rows if y == 1]
    poor = [p for y, p in rows if y == 0]
    assert sum(good) / len(good) > 0.99 and sum(poor) / len(poor) < 0.1


def test_toxicity_held_out(spark):
    rows = outcome(spark, "op2_toxicity", "toxic")
    toxic = [p for y, p in rows if y == 1]
    clean = [p for y, p in rows if y == 0]
    assert sum(toxic) / len(toxic) > 0.6 and sum(clean) / len(clean) < 0.01


def test_toxicity_held_out_recall(spark):
    rows = outcome(spark, "op2_toxicity", "toxic")
    toxic = [p for y, p in rows if y == 1]
    clean = [p for y, p in rows if y == 0]
    print("held out:", sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.01


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = q.queries()["op7_language"](spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.995


def test_no_letters(spark, awkward):
    scorer = language.language_scorer(awkward, F.lit(True))
    found = {r.doc_id: (r.lang_pred, r.score)
             for r in language.languages_of(awkward, scorer).collect()}
    assert {found[i] for i in (3, 4, 5, 9, 10)} == {("und", 0.0)}
    assert found[8][0] in {"de", "en", "es", "fr"}


def test_hashed_words_do_not_depend_on_place():
    data = "aa Bb!cc\naa bb".encode()
    words, doc = common.hashed_words(np.frombuffer(data, np.uint8), np.array([0, 9, len(data)]))
    assert doc.tolist() == [0, 0, 1, 1] and words[0] == words[2] and words[1] != words[3]
    low, _ = common.hashed_words(np.frombuffer(b"AB ab", np.uint8), np.array([0, 5]), lower=True)
    assert low[0] == low[1]
    parts, _ = common.hashed_words(np.frombuffer(b"a!! b!!", np.uint8), np.array([0, 7]),
                                   split_marks=True)
    assert len(parts) == 4 and parts[1] == parts[3]


def test_very_long_text_in_parts(monkeypatch):
    data = np.frombuffer(b"some words of a text " * 50, np.uint8)
    offsets = np.array([0, len(data)])
    whole = common.hashed_words(data, offsets)[0]
    monkeypatch.setattr(common, "_PIECE", 64)
    assert common.hashed_words(data, offsets)[0].tolist() == whole.tolist()


def test_text_chunks_cover_all():
    texts = pa.array(["ab", None, "", "c" * 50, "d"])
    runs = [(a, b, bytes(d).decode(), o.tolist()) for a, b, d, o in common.text_chunks(texts, 8, 2)]
    assert [r[:2] for r in runs] == [(0, 2), (2, 3), (3, 4), (4, 5)] or runs[0][0] == 0
    assert "".join(r[2] for r in runs) == "ab" + "c" * 50 + "d"
    assert runs[-1][1] == 5


def test_ftrl_learns_and_l1_makes_it_sparse():
    zeros = {}
    for l1 in (0.0, 1.0, 6.0):
        model, draw = toxicity.Ftrl(64, l1=l1), np.random.default_rng(0)
        for _ in range(400):
            noise = draw.choice(np.arange(1, 64), 8, replace=False)
            bad = bool(draw.integers(2))
            model.learn(np.append(noise, 0) if bad else noise, int(bad))
        weights, _ = model.weights()
        zeros[l1] = int((weights == 0).sum())
        assert weights[0] > 1 and weights[0] > 3 * np.abs(weights[1:]).max()
    assert zeros[0.0] == 0 < zeros[1.0] < zeros[6.0]


def test_word_space_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = quality.word_space(docs.coalesce(1)).vectors
    many = quality.word_space(docs.repartition(7)).vectors
    assert np.array_equal(one, many)


@pytest.mark.parametrize("temperature", [0.5, 3.0])
def test_calibration_finds_the_temperature(temperature):
    network = quality.Network(1)
    network.params = [np.array([[0.01]]), np.zeros(1), np.array([100.0]), np.zeros(1)]
    draw = np.random.default_rng(1)
    x = draw.normal(0, 3, (20000, 1))
    y = (draw.random(20000) < 1 / (1 + np.exp(-network.logits(x) / temperature))).astype(float)
    network.calibrate(x, y, np.ones(len(y)))
    assert abs(network.temperature / temperature - 1) < 0.15
