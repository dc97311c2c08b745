"""Quality by random indexing, pooling and a small network with calibrated probabilities.

Every hashed word has a sparse random index vector. A word's own vector is the sum of the index
vectors that stand near it anywhere in the corpus: one integer table of fixed size, added up
over all texts. A text is the mean and the spread of its words' vectors. A network with one
hidden layer learns the labels; a temperature fitted on rows it has not learnt from makes its
outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import hashed_words, mix, text_chunks
from fieldgauge.llm.toxicity import sampled

WINDOW = 2
#: Non-zero places of an index vector.
MARKS = 4


class WordSpace:
    """Index vectors of hashed words, and the vectors that the corpus gives them."""

    def __init__(self, buckets: int, size: int):
        self.buckets, self.size = buckets, size
        seeds = mix(np.arange(buckets * MARKS, dtype=np.uint64)).reshape(buckets, MARKS)
        self.places = (seeds % np.uint64(size)).astype(np.int64)
        self.signs = np.where(seeds >> np.uint64(63), 1.0, -1.0)
        self.vectors: np.ndarray | None = None

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, doc = hashed_words(data, offsets, split_marks=True)
        return (words % np.uint64(self.buckets)).astype(np.int64), doc

    def add_contexts(self, table: np.ndarray, words: np.ndarray, doc: np.ndarray) -> None:
        """Adds to each word's row the index vectors of its neighbours; the last column counts
        them."""
        flat, wide = table.reshape(-1), self.size + 1
        for gap in range(1, WINDOW + 1):
            same = doc[:-gap] == doc[gap:]
            left, right = words[:-gap][same], words[gap:][same]
            for word, near in ((left, right), (right, left)):
                flat += np.bincount(word * wide + self.size, minlength=len(flat))
                for k in range(MARKS):
                    flat += np.bincount(word * wide + self.places[near, k],
                                        self.signs[near, k], len(flat)).astype(np.int64)

    def learn(self, table: np.ndarray) -> None:
        """Unit vectors of the contexts beyond what every word's contexts hold."""
        sums, counts = table[:, :-1].astype(float), table[:, -1:].astype(float)
        usual = sums.sum(0) / max(counts.sum(), 1.0)
        own = sums - counts * usual
        norms = np.linalg.norm(own, axis=1, keepdims=True)
        self.vectors = (own / np.maximum(norms, 1e-12)).astype(np.float32)

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Mean and spread of each text's word vectors, the mean cosine of neighbouring ones
        and the log of their number; zeros without words."""
        out = np.zeros((len(texts), 2 * self.size + 2), np.float32)
        for first, end, data, offsets in text_chunks(texts):
            words, doc = self.words(data, offsets)
            if not len(words):
                continue
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            n = np.diff(np.append(starts, len(words)))[:, None]
            found = self.vectors[words]
            mean = np.add.reduceat(found, starts) / n
            square = np.add.reduceat(found * found, starts) / n
            spread = np.sqrt(np.maximum(square - mean * mean, 0))
            alike = np.einsum("ij,ij->i", found[:-1], found[1:])
            alike[doc[:-1] != doc[1:]] = 0
            beside = np.add.reduceat(np.append(alike, 0), starts)[:, None] / n
            out[first + doc[starts]] = np.hstack([mean, spread, beside, np.log1p(n)])
        return out


def word_space(docs: DataFrame, text_col: str = "text", buckets: int = 1 << 13,
               size: int = 32) -> WordSpace:
    """The corpus's word vectors, from the neighbours of every word of every text.

    Each task adds up one table of ``buckets`` rows; only such rows are shuffled, and
    ``buckets * size`` integers come to the driver. Sums are whole numbers, so reruns agree.
    """
    space = WordSpace(buckets, size)
    names = [f"v{i}" for i in range(size + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((buckets, size + 1), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words, doc = space.words(data, offsets)
                if len(words) > WINDOW:
                    space.add_contexts(table, words, doc)
        used = np.flatnonzero(table[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(table[used, i]) for i in range(size + 1)]],
            names=["bucket", *names])

    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    sums = (docs.select(text_col).mapInArrow(count, schema).groupBy("bucket")
            .agg(*[F.sum(n).alias(n) for n in names]).toArrow())
    table = np.zeros((buckets, size + 1), np.int64)
    table[sums["bucket"].to_numpy()] = np.column_stack([sums[n].to_numpy() for n in names])
    space.learn(table)
    return space


class Network:
    """Inputs, a tanh layer and one logit, trained by Adam on the log loss."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(inputs), np.ones(inputs)
        self.params = [draw.normal(0, inputs ** -0.5, (inputs, hidden)), np.zeros(hidden),
                       draw.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.temperature, self.draw = 1.0, draw

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40,
              batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.center, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.center) / self.scale
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params]
        step = 0
        for _ in range(epochs):
            order = self.draw.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                rows = order[i:i + batch]
                w1, b1, w2, b2 = self.params
                hidden = np.tanh(x[rows] @ w1 + b1)
                out = hidden @ w2 + b2[0]
                error = (1 / (1 + np.exp(-np.clip(out, -35, 35))) - y[rows]) * weight[rows] \
                    / len(rows)
                back = np.outer(error, w2) * (1 - hidden ** 2)
                slopes = [x[rows].T @ back + decay * w1, back.sum(0),
                          hidden.T @ error + decay * w2, np.array([error.sum()])]
                for p, g, m in zip(self.params, slopes, moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= rate * (m[0] / (1 - 0.9 ** step)) \
                        / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature of least weighted log loss on these rows."""
        logits = self.logits(x)
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        losses = [np.average(np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t),
                             weights=weight) for t in tried]
        self.temperature = float(tried[int(np.argmin(losses))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


class QualityScorer:
    """Probabilities of an Arrow column of texts."""

    def __init__(self, space: WordSpace, network: Network | None, share: float):
        self.space, self.network, self.share = space, network, share

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(self.space.pooled(texts))


def quality_scorer(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "quality",
                   id_col: str = "doc_id", text_col: str = "text", bound: int = 5000,
                   buckets: int = 1 << 13, size: int = 32) -> QualityScorer:
    """Word vectors from all of ``docs``; a network from at most ``bound`` texts of each label.

    ``seen`` says which rows of ``labels`` may be learnt from. One in five of them sets the
    temperature instead. Rows are weighted so that the classes count as in all of ``labels``.
    With one class only, every score is that class's share.
    """
    space = word_space(docs, text_col, buckets, size)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = space.pooled(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pooled), pa.list_(pa.float32())), *batch.columns[1:]],
                names=["x", "label", "draw"])

    # The sample has at most 2 * bound rows of a few bytes.
    picked = F.broadcast(sampled(labels, label, bound, seen, id_col))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(picked, F.col("id") == F.col("of"))
        .select("text", F.col("label").cast("long").alias("label"),
                F.xxhash64(F.lit("order"), "of").alias("draw"))
        .mapInArrow(pool, "x array<float>, label long, draw long").toArrow()
    )
    share = labels.where(seen).agg(F.avg(F.col(label).cast("double"))).first()[0]
    y = rows["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return QualityScorer(space, None, 0.5 if share is None else float(share))
    x = np.stack(rows["x"].to_numpy()).astype(float)
    draw = rows["draw"].to_numpy()
    order = np.lexsort((x[:, -1], x[:, 0], draw))
    x, y, held = x[order], y[order], (draw[order] % 5 == 0)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    network = Network(x.shape[1])
    network.train(x[~held], y[~held], weight[~held])
    if held.any():
        network.calibrate(x[held], y[held], weight[held])
    return QualityScorer(space, network, float(share))
