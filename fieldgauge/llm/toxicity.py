"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The rate of each coordinate falls with its own squared gradients, and the L1 term leaves most
weights at zero, so the model is a short list of (coordinate, weight), at most ``dimensions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldgauge.llm.common import grams, hashed_words, stored, text_chunks

#: Word tuples by the places of their later words: pairs, triples, and pairs over one or two.
TUPLES = ((1,), (1, 2), (2,), (3,))
#: The value of a tuple where a word counts as 1, so that rare tuples don't replace words. This,
#: ``l1`` and ``epochs`` were chosen on inner folds of op2's training rows at sf0.1.
TUPLE_VALUE = 0.5


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and text numbers of all word n-grams and skip-grams; words are in the lower
    half of the coordinates."""
    words, doc = hashed_words(data, offsets, lower=True, split_marks=True)
    parts = [(words, doc), *(grams(words, doc, gaps) for gaps in TUPLES)]
    half = np.uint64(dimensions // 2)
    hashes = [(h & (half - np.uint64(1))) + (half if i else np.uint64(0))
              for i, (h, _) in enumerate(parts)]
    return (np.concatenate(hashes).astype(np.int64),
            np.concatenate([d for _, d in parts]))


class Ftrl:
    """FTRL-proximal for features that are 0, or 1 or a given value."""

    def __init__(self, dimensions: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.7,
                 l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)  # the intercept is free
        free = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -free / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int, value: np.ndarray | float = 1.0) -> None:
        value = np.append(np.broadcast_to(value, at.shape), 1.0)
        at = np.append(at, len(self.z) - 1)
        w = self._weights(at)
        gradient = (1 / (1 + np.exp(-np.clip((w * value).sum(), -35, 35))) - label) * value
        step = (np.sqrt(self.n[at] + gradient ** 2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] += gradient ** 2

    def weights(self) -> tuple[np.ndarray, float]:
        w = self._weights(np.arange(len(self.z)))
        return w[:-1].astype(np.float32), float(w[-1])


def sampled(labels: DataFrame, label: str, bound: int, seen: Column, id_col: str = "doc_id"
            ) -> DataFrame:
    """At most ``bound`` labelled rows of each class, by a hash of the id; ids with
    contradicting labels are left out."""
    clear = (
        labels.where(seen & F.col(label).isin(0, 1)).groupBy(id_col)
        .agg(F.min(label).alias("label"), F.max(label).alias("high"))
        .where(F.col("label") == F.col("high"))
    )
    order = F.xxhash64(F.lit("sample"), id_col)
    picks = [clear.where(F.col("label") == c).orderBy(order, id_col).limit(bound)
             for c in (0, 1)]
    return picks[0].unionByName(picks[1]).select(F.col(id_col).alias("of"), "label")


def scale(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits of rows not learnt from fit their labels (Platt's
    targets, Newton steps); (1, 0) if a label has under five rows or the slope isn't positive."""
    n = np.bincount(label, minlength=2)
    if n.min() < 5:
        return 1.0, 0.0
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, at = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (weight * (p - target)))
        at = at - np.clip(step, -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 and np.isfinite(at).all() else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str, seen: Column, id_col: str = "doc_id",
        text_col: str = "text", dimensions: int = 1 << 20, bound: int = 4000, epochs: int = 8,
        l1: float = 10.0, most_bytes: int = 1 << 28) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and intercept, learnt from at most ``bound`` texts of each label,
    fewer if their coordinates take more than ``most_bytes`` on the driver.

    An id gives one text, the least of those it stands on. ``seen`` says which rows of ``labels`` may be learnt from. The intercept is corrected for
    the classes' unequal shares of the sample; slope and shift of the logits are fitted to the
    third of the sample that a first model has not learnt from. Without both labels every
    weight is zero.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(0)):
                at, doc = features(data, offsets, dimensions)
                pairs = np.unique(doc * dimensions + at)
                bounds = np.searchsorted(pairs, np.arange(end - first + 1) * dimensions)
                coordinates = (pairs % dimensions).astype(np.int32)
                held = [coordinates[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.binary()), batch.column(1)[first:end],
                     batch.column(2)[first:end]], names=["at", "label", "draw"])

    # The sample has at most 2 * bound rows of a few bytes.
    picked = F.broadcast(sampled(labels, label, bound, seen, id_col))
    rows = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(picked, F.col("id") == F.col("of"))
        .groupBy("of", "label").agg(F.min("text").alias("text"))
        .select("text", F.col("label").cast("long").alias("label"),
                F.xxhash64(F.lit("order"), "of").alias("draw"))
        .mapInArrow(encode, "at binary, label long, draw long"), "toxicity-sample")
    # Which rows fit is decided from their sizes; then one file's rows at a time come over, so
    # the driver holds the coordinates once.
    sizes = rows.select("label", "draw", F.octet_length("at").alias("size")) \
        .orderBy("label", "draw", "size").toArrow().to_pydict()
    room, fits = {}, set()
    for c, draw, n in zip(sizes["label"], sizes["draw"], sizes["size"]):
        room[c] = room.get(c, most_bytes // 2) - n
        if room[c] >= 0:
            fits.add((c, draw))
    held_rows, label_list, draws = [], [], []
    for r in rows.toLocalIterator():
        if (r["label"], r["draw"]) in fits:
            held_rows.append(np.frombuffer(r["at"], np.int32))
            label_list.append(r["label"])
            draws.append(r["draw"])
    label_of, draws = np.array(label_list, np.int64), np.array(draws, np.int64)
    share = labels.where(seen).agg(F.avg(F.col(label).cast("double"))).first()[0]
    if len(set(label_of.tolist())) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), float(
            np.log(((share or 0) + 1e-3) / (1 - (share or 0) + 1e-3)))
    # Models are as long as the coordinates that occur.
    occurs = np.zeros(dimensions, bool)
    for held in held_rows:
        occurs[held] = True
    present = np.flatnonzero(occurs)
    place_of = np.cumsum(occurs, dtype=np.int32) - 1
    for i, held in enumerate(held_rows):
        held_rows[i] = place_of[held]
    words = int(np.searchsorted(present, dimensions // 2))
    order = np.lexsort((label_of, draws))
    drawn = label_of.mean()
    prior = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))

    def texts(rows):
        for i in rows:
            held = held_rows[i]
            yield i, held, np.where(held < words, 1.0, TUPLE_VALUE)

    def learnt(rows: np.ndarray) -> tuple[np.ndarray, float]:
        model = Ftrl(len(present), l1=l1)
        for _ in range(epochs):
            for i, held, value in texts(rows):
                model.learn(held, int(label_of[i]), value)
        weights, intercept = model.weights()
        weights[words:] *= TUPLE_VALUE
        return weights, float(intercept + prior)

    # By places in each label's own order, so that both thirds hold both labels.
    place = np.empty(len(order), np.int64)
    for c in (0, 1):
        rows_of = order[label_of[order] == c]
        place[rows_of] = np.arange(len(rows_of))
    inner = place % 3 == 0
    weights, intercept = learnt(order[~inner[order]])
    left_out = order[inner[order]]
    logit = np.array([weights[held].sum(dtype=float) + intercept
                      for _, held, _ in texts(left_out)])
    each = np.where(label_of[left_out] == 1, share / drawn, (1 - share) / (1 - drawn))
    slope, shift = scale(logit, label_of[left_out], each)
    weights, intercept = learnt(order)
    weights, intercept = (weights * slope).astype(np.float32), intercept * slope + shift
    used = np.flatnonzero(weights)
    return present[used], weights[used], float(intercept)


class Scorer:
    """Probabilities of an Arrow column of texts."""

    def __init__(self, coordinates: np.ndarray, weights: np.ndarray, intercept: float,
                 dimensions: int):
        self.coordinates, self.weights = coordinates, weights
        self.intercept, self.dimensions = intercept, dimensions
        self.table = None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:  # spread out on the worker; only the list is sent there
            self.table = np.zeros(self.dimensions, np.float32)
            self.table[self.coordinates] = self.weights
        out = np.empty(len(texts))
        for first, end, data, offsets in text_chunks(texts):
            at, doc = features(data, offsets, self.dimensions)
            counted = np.flatnonzero(self.table[at])
            pairs = np.unique(doc[counted] * self.dimensions + at[counted])
            total = np.bincount(pairs // self.dimensions,
                                self.table[pairs % self.dimensions].astype(float), end - first)
            out[first:end] = 1 / (1 + np.exp(-np.clip(total + self.intercept, -35, 35)))
        return out


def scored(docs: DataFrame, scorer, text_col: str = "text", score: str = "score",
           least: float | None = None, most: float | None = None) -> DataFrame:
    """The rows of ``docs`` with a column of scores; or, with ``least`` or ``most``, its own
    columns for the rows whose score is at least that or below that."""
    place = docs.columns.index(text_col)
    filtering = least is not None or most is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column(place))
            if filtering:
                kept = np.ones(len(scores), bool) if least is None else scores >= least
                kept &= True if most is None else scores < most
                yield batch.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(scores, pa.float64())],
                    names=[*batch.schema.names, score])

    schema = docs.schema if filtering else T.StructType(
        [*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity_scorer(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "toxic",
                    id_col: str = "doc_id", text_col: str = "text", dimensions: int = 1 << 20,
                    bound: int = 4000) -> Scorer:
    """The fitted model. A NULL or empty text scores the intercept's probability."""
    return Scorer(*fit(docs, labels, label, seen, id_col, text_col, dimensions, bound),
                  dimensions)
