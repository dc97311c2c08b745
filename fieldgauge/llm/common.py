"""Helpers shared by the operators: scratch tables, fold membership, words of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.session import scratch_path

#: The white space that separates words.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and a lost
    executor takes nothing with it."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a NULL key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def text_chunks(texts: pa.Array, max_bytes: int = 1 << 20, max_docs: int = 1024
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts as (first, end, UTF-8 bytes, offsets into them); NULL is empty.

    A run holds at most ``max_bytes`` unless a single text is longer.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        end = min(max(end, first + 1), first + max_docs, len(column))
        yield (first, end, data[offsets[first]:offsets[end]],
               offsets[first:end + 1] - offsets[first])
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _classes(split_marks: bool) -> np.ndarray:
    kind = np.ones(256, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    if split_marks:
        letters = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
        kind[[b for b in range(256) if kind[b] and b not in letters]] = 2
    return kind


#: A single text longer than this many bytes is hashed in parts.
_PIECE = 1 << 22
_KIND = {marks: _classes(marks) for marks in (False, True)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
                 split_marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of its text, in text order.

    Words are runs without white space; ``split_marks`` also parts runs of ASCII punctuation
    from letters and digits; ``lower`` folds ASCII capitals. A word hashes to a polynomial in
    its bytes, so it has the same hash wherever it stands.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) > _PIECE and len(offsets) == 2:
        gaps = np.flatnonzero(_KIND[False][data] == 0)
        cut = gaps[np.searchsorted(gaps, _PIECE // 2):][:1]
        if len(cut):  # a very long text, in two parts that meet at white space
            ends = (np.array([0, cut[0]]), np.array([0, len(data) - cut[0]]))
            halves = [hashed_words(d, o, lower, split_marks)[0]
                      for d, o in zip((data[:cut[0]], data[cut[0]:]), ends)]
            words = np.concatenate(halves)
            return words, np.zeros(len(words), np.int64)
    kind = _KIND[split_marks][data]
    before = np.empty_like(kind)
    before[0] = 0
    before[1:] = kind[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = 0
    starts = np.flatnonzero((kind != 0) & (kind != before))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(data))
    parts = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    parts *= up[:len(data)]
    parts[kind == 0] = 0
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return mix(np.add.reduceat(parts, starts) * down[starts]), doc


def grams(words: np.ndarray, doc: np.ndarray, gaps: tuple[int, ...]
          ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word tuples: each word with those the given numbers of places further on."""
    reach = max(gaps)
    n = len(words) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = doc[:n] == doc[reach:]
    h = words[:n][same]
    for gap in gaps:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[gap:gap + n][same]
                + np.uint64(gap))
    return h, doc[:n][same]
