"""Language by hierarchical discrimination: the family first, then the language within it.

Texts are unit vectors of hashed byte triples. Families are told apart by one-versus-rest
linear support vector machines; within a family every pair of languages has a machine of its
own and the languages are ranked by the pairs they win. All machines are trained on a bounded
sample and are matrices of fixed width.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import text_chunks

#: Families of languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": "de en nl da sv no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky", "indic": "hi ur bn mr pa gu ne",
    "sinitic": "zh yue wuu", "semitic": "ar he mt am",
}
UNDETERMINED = "und"


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), language)


def profiles(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> np.ndarray:
    """A unit row per text: damped counts of hashed byte triples; ASCII capitals, digits and
    punctuation count as their small letter, 0 and a space."""
    fold = np.arange(256, dtype=np.uint64)
    fold[:0x80] = 0x20
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    fold[0x30:0x3A] = 0x30
    n = len(offsets) - 1
    folded = fold[data]
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    counts = np.zeros((n, dimensions))
    if len(data) > 2:
        inner = doc[:-2] == doc[2:]
        triple = (folded[:-2] << np.uint64(16) | folded[1:-1] << np.uint64(8) | folded[2:])[inner]
        # Runs of what is no letter tell nothing.
        told = triple != 0x202020
        at = (triple * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(dimensions)
        key = doc[:-2][inner] * dimensions + at.astype(np.int64)
        counts = np.bincount(key[told], minlength=n * dimensions).reshape(n, dimensions)
    rows = np.sqrt(counts).astype(np.float32)
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.maximum(norms, 1e-12)


def linear_machine(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12,
                   seed: int = 3) -> np.ndarray:
    """Weights, the last one the intercept, of an L2-regularised squared-hinge machine by dual
    coordinate descent; y holds -1 and 1, each class with half of the cost."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    give = 0.5 / (cost * share)
    square = (x * x).sum(1) + give
    w, dual = np.zeros(x.shape[1]), np.zeros(len(x))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + give[i] * dual[i]
            new = max(dual[i] - gradient / square[i], 0.0)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return w


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * margin, -35, 35)))


class LanguageScorer:
    """Language and score of an Arrow column of texts."""

    def __init__(self, languages: list[str], dimensions: int):
        self.languages, self.dimensions = languages, dimensions
        self.families: list[list[int]] = []
        for name in sorted({family_of(x) for x in languages}):
            self.families.append([i for i, x in enumerate(languages) if family_of(x) == name])
        self.family_weights = np.zeros((len(self.families), dimensions + 1))
        self.pair_weights: dict[tuple[int, int], np.ndarray] = {}

    def learn(self, x: np.ndarray, label: np.ndarray) -> None:
        for f, members in enumerate(self.families):
            inside = np.isin(label, members)
            if len(self.families) > 1:
                self.family_weights[f] = linear_machine(x, np.where(inside, 1.0, -1.0))
            for a, b in combinations(members, 2):
                rows = (label == a) | (label == b)
                self.pair_weights[a, b] = linear_machine(
                    x[rows], np.where(label[rows] == a, 1.0, -1.0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores: the family's share times the mean over its pairs."""
        margins = _squash(x @ self.family_weights[:, :-1].T + self.family_weights[:, -1])
        family = margins.argmax(1)
        sure = margins[np.arange(len(x)), family] / np.maximum(margins.sum(1), 1e-12)
        language, score = np.zeros(len(x), int), np.ones(len(x))
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            belief = np.zeros_like(votes)
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                w = self.pair_weights[a, b]
                p = _squash(x[rows] @ w[:-1] + w[-1])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                belief[:, i] += p
                belief[:, j] += 1 - p
            # Pairs won decide, their summed beliefs break ties.
            best = (votes + belief / (len(members) + 1)).argmax(1)
            language[rows] = np.array(members)[best]
            pairs = max(len(members) - 1, 1)
            score[rows] = sure[rows] * (belief[np.arange(len(rows)), best] / pairs
                                        if len(members) > 1 else 1.0)
        return language, np.clip(score, 0.0, 1.0)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
        for first, end, data, offsets in text_chunks(texts, max_docs=256):
            if not self.languages:
                names += [UNDETERMINED] * (end - first)
                continue
            language, score = self.decide(profiles(data, offsets, self.dimensions))
            names += [self.languages[i] for i in language]
            scores[first:end] = score
        told = lettered.to_numpy(zero_copy_only=False)
        scores[~told] = 0.0
        return [n if t else UNDETERMINED for n, t in zip(names, told)], scores


def language_scorer(docs: DataFrame, seen: Column, lang_col: str = "lang",
                    id_col: str = "doc_id", text_col: str = "text", bound: int = 6000,
                    dimensions: int = 1 << 11) -> LanguageScorer:
    """Machines learnt from about ``bound`` texts, shared evenly by the languages, chosen by a
    hash of the id. Only rows that ``seen`` names and whose language is not NULL are used."""
    taught = docs.where(seen & F.col(lang_col).isNotNull()
                        & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    # One row per language.
    sizes = {r[0]: r[1] for r in taught.groupBy(F.col(lang_col).cast("string").alias("lang"))
             .count().toLocalIterator()}
    scorer = LanguageScorer(sorted(sizes), dimensions)
    if not sizes:
        return scorer
    each = max(bound // len(sizes), 20)
    chosen = F.create_map(*[v for name, n in sizes.items()
                            for v in (F.lit(name), F.lit(min(1.0, each / n)))])
    draw = F.xxhash64(F.lit("language"), F.col(id_col))
    fraction = F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(0), max_docs=256):
                rows = profiles(data, offsets, dimensions)
                where, at = np.nonzero(rows)
                bounds = np.searchsorted(where, np.arange(len(rows) + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                             pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                             pa.array(rows[where, at], pa.float32())),
                    batch.column(1)[first:end], batch.column(2)[first:end]],
                    names=["at", "value", "lang", "draw"])

    sample = (
        taught.where(fraction < chosen[F.col(lang_col).cast("string")])
        .select(F.col(text_col), F.col(lang_col).cast("string"), draw.alias("draw"))
        .mapInArrow(profile, "at array<int>, value array<float>, lang string, draw long")
        .toArrow()
    )
    x = np.zeros((sample.num_rows, dimensions), np.float32)
    at = sample["at"].combine_chunks()
    rows = np.repeat(np.arange(sample.num_rows), np.diff(at.offsets.to_numpy()))
    x[rows, at.values.to_numpy()] = sample["value"].combine_chunks().values.to_numpy()
    label = np.array([scorer.languages.index(v) for v in sample["lang"].to_pylist()], int)
    order = np.lexsort((x.sum(1), label, sample["draw"].to_numpy()))
    scorer.learn(x[order], label[order])
    return scorer


def languages_of(docs: DataFrame, scorer: LanguageScorer, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred and score. A text that is NULL or has no letter is ``und``
    with score 0, as is every text if nothing could be learnt. Repeated rows are judged one by
    one; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)],
                names=[id_col, "lang_pred", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double")
