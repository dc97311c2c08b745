"""How the tokens of two tokenizers line up over the same texts.

A text's tokens under A and B are cut into groups at the byte offsets where tokens of both end.
Most groups are one token of each with the same bytes. Which B id has the bytes of an A id is
known beforehand (``identity_map``), so these groups are counted in one vector as long as A's
vocabulary. Only the pairs of the other, irregular groups are shuffled to be counted.

Pairs that make up a ``1 / frequent`` share of the irregular links or more are at most
``frequent``; their counts, the vector and the highest count of each B id go to the tasks, whose
size is thus bounded by parameters and vocabularies. The links of rarer pairs are joined with
their counts, and none of those is a hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import stored
from fieldgauge.llm.encoding import GAP, INK, Encoder, default_vocabulary, text_runs

#: The text can be cut before a space that follows a character other than white space: no
#: pre-token of A and no piece of B holds such a place. A cut takes the space away.
_CUT = re.compile(f"(?<={INK}) ")
#: Texts where some space is no such place.
_ODD = re.compile(f"(?:^|{GAP}) ")
#: Distinct cuts of texts kept per worker, about 120 MB.
CACHE_CUTS = 300_000
#: Distinct pairs a task holds before it passes their counts on.
HELD_PAIRS = 1 << 20


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; none for other entries."""
    # Printable characters of Latin-1 stand for their own byte, the other bytes for the
    # characters from 256 on, in order.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in byte_of for c in token):
            out[i] = bytes(byte_of[c] for c in token)
    return out


def piece_bytes(processor) -> list[bytes]:
    """The bytes of every sentence piece; none for control pieces."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Per A id the B id with the same bytes, -1 without one; whole pieces before bytes."""
    of: dict[bytes, int] = {}
    for i, held in enumerate(b):
        of[held] = i  # pieces stand after the bytes
    of.pop(b"", None)
    return np.array([of.get(held, -1) for held in a], np.int64)


def cut_at_spaces(text: str) -> list[str]:
    """The cuts of space + text, without the space that each begins with."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Runs:
    """Runs of numbers by index, in one growing array."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(counts) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[self.n:self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.counts[self.n:self.n + len(counts)] = counts
        self.used, self.n = self.used + len(flat), self.n + len(counts)

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.starts[at], self.counts[at])]


class Aligner:
    """Tokens, groups and links of texts; each distinct cut is aligned once per worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self._encoder = Encoder(a_path)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self._bytes_a = byte_level_bytes(self._encoder.vocabulary)
        self._bytes_b = piece_bytes(self._pieces)
        self.size_a, self.size_b = len(self._bytes_a), len(self._bytes_b)
        self.same = identity_map(self._bytes_a, self._bytes_b)
        self._lengths_a = np.array([len(b) for b in self._bytes_a])
        self._lengths_b = np.array([len(b) for b in self._bytes_b])
        self._shown = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]
        self._space = self._pieces.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._groups: list[str] = []
        self.regular = Runs(np.uint32)    # A ids of one-to-one groups with equal bytes
        self.irregular = Runs(np.uint64)  # a * size_b + b of the other links
        self.figures = Runs(np.int64)     # n_a, n_b, n_groups, n_links, whether bytes agree

    def _learn(self, cuts: list[str]) -> None:
        ids_a = self._encoder.fresh([" " + c for c in cuts])
        ids_b = [b if c else [self._space]
                 for c, b in zip(cuts, self._pieces.encode(cuts, num_threads=1))]
        true = [b" " + c.encode() for c in cuts]
        good = np.array([
            b"".join(map(self._bytes_a.__getitem__, np.frombuffer(a, "<u4").tolist())) == t
            and b"".join(map(self._bytes_b.__getitem__, b)) == t
            for a, b, t in zip(ids_a, ids_b, true)], bool)
        ids_a = [a if g else b"" for a, g in zip(ids_a, good)]
        ids_b = [b if g else () for b, g in zip(ids_b, good)]
        a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        n, n_a = len(cuts), np.array([len(x) // 4 for x in ids_a])
        n_b = np.array([len(x) for x in ids_b])
        of_a = np.repeat(np.arange(n), n_a)
        ends_a, ends_b = np.cumsum(self._lengths_a[a]), np.cumsum(self._lengths_b[b])
        starts_a, starts_b = ends_a - self._lengths_a[a], ends_b - self._lengths_b[b]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a = np.bincount(np.searchsorted(common, ends_a), minlength=len(common))
        in_b = np.bincount(np.searchsorted(common, ends_b), minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        regular = (in_a == 1) & (in_b == 1)
        regular[regular] = self.same[a[first_a[regular]]] == b[first_b[regular]]
        of_group = of_a[first_a]
        low = np.searchsorted(ends_b, starts_a, side="right")
        links = np.searchsorted(starts_b, ends_a, side="left") - low
        odd = ~np.repeat(regular, in_a)
        pairs = (np.repeat(a[odd], links[odd]) * self.size_b
                 + b[_spread(low[odd], links[odd])])
        self.regular.add(a[first_a[regular]].astype(np.uint32),
                         np.bincount(of_group[regular], minlength=n))
        self.irregular.add(pairs.astype(np.uint64),
                           np.bincount(of_a[odd], links[odd], n).astype(np.int64))
        n_groups = np.bincount(of_group, minlength=n)
        figures = np.stack([n_a, n_b, n_groups,
                            np.bincount(of_a, links, n).astype(np.int64), good], 1)
        self.figures.add(figures.reshape(-1), np.full(n, 5))
        shown_a, shown_b = [list(map(str, x.tolist())) for x in (a, b)]
        shown = []
        for one, ident, x, u, v, w in zip(regular.tolist(), a[first_a].tolist(),
                                          first_a.tolist(), in_a.tolist(), first_b.tolist(),
                                          in_b.tolist()):
            shown.append(self._shown[ident] if one else
                         ",".join(shown_a[x:x + u]) + "|" + ",".join(shown_b[v:v + w]))
        at = 0
        for c, count in zip(cuts, n_groups.tolist()):
            self._place[c] = len(self._groups)
            self._groups.append(";".join(shown[at:at + count]))
            at += count

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """Per text n_a, n_b, n_groups, n_links, the groups as text, the A ids of regular groups
        and the irregular pairs; zeros and nothing where the texts' bytes don't come back."""
        if len(self._place) > CACHE_CUTS:
            self._forget()
        cut = [cut_at_spaces(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self._place)
        fresh = sorted(fresh)
        for i in range(0, len(fresh), 20000):
            self._learn(fresh[i:i + 20000])
        place = self._place.__getitem__
        for cuts in cut:
            at = np.fromiter(map(place, cuts), np.int64, len(cuts))
            figures = self.figures.take(at).reshape(-1, 5)
            # A cut whose bytes don't come back has none of their length, so neither has the
            # text: pieces lose bytes (a mark that stands for the space) and never gain any.
            if not len(at) or not figures[:, 4].all():
                yield 0, 0, 0, 0, "", b"", b""
                continue
            shown = ";".join(map(self._groups.__getitem__, at.tolist()))
            yield (*figures[:, :4].sum(0).tolist(), shown,
                   np.sort(self.regular.take(at)).tobytes(),
                   np.sort(self.irregular.take(at)).tobytes())


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process, kept from task to task."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_MEASURED = ("row long, id long, n_a long, n_b long, n_groups long, n_links long, "
             "groups_sha256 string, regular binary, irregular binary")


def measured(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs: id, text. Per row a number of its own, the figures of ``align``, regular ids (as
    32-bit) and irregular pairs (as 64-bit integers), both sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, align = TaskContext.get().partitionId() << 40, aligner(a_path, b_path).align
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                rows = [(*f, hashlib.sha256(shown.encode()).hexdigest() if shown else "", r, i)
                        for *f, shown, r, i in align(texts)]
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(rows)), pa.int64()),
                     batch.column(0)[first:first + len(rows)],
                     *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    names=["row", "id", *_FIGURES, "groups_sha256", "regular", "irregular"])
                row += len(rows)
    return docs.mapInArrow(run, _MEASURED)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a binary column end to end, and the number of its row for each."""
    bodies = column.to_pylist()
    flat = np.frombuffer(b"".join(bodies), kind)
    size = np.dtype(kind).itemsize
    return flat, np.repeat(np.arange(len(bodies)), [len(x) // size for x in bodies])


def pair_counts(rows: DataFrame, same: np.ndarray, size_b: int) -> DataFrame:
    """pair (a * size_b + b), n (its links), odd (those of irregular groups) and whether some
    regular group holds it. Every task counts before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pair", "n", "odd", "plain"]
        vector = np.zeros(len(same), np.int64)
        pairs, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def passed_on(pairs, ns):
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs.astype(np.int64)), pa.array(ns), pa.array(ns),
                 pa.array(np.zeros(len(ns), bool))], names=names)

        for batch in batches:
            vector += np.bincount(_flat(batch.column(0), "<u4")[0], minlength=len(same))
            new, n = np.unique(_flat(batch.column(1), "<u8")[0], return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            ns = np.bincount(back, np.concatenate([ns, n]), len(pairs)).astype(np.int64)
            if len(pairs) > HELD_PAIRS:
                yield passed_on(pairs, ns)
                pairs, ns = pairs[:0], ns[:0]
        yield passed_on(pairs, ns)
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a * size_b + same[a]), pa.array(vector[a]),
             pa.array(np.zeros(len(a), np.int64)), pa.array(np.ones(len(a), bool))], names=names)

    return (rows.select("regular", "irregular")
            .mapInArrow(count, "pair long, n long, odd long, plain boolean")
            .groupBy("pair").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"),
                                 F.bool_or("plain").alias("plain")))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            a_vocabulary: str | None = None, b_pieces: str | None = None,
            frequent: int = 1 << 18) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A's tokens are those of a space and the text, B's those of the text (B adds the space). A
    link joins an A and a B token whose bytes overlap; a pair's count is the number of links
    between its two ids over all rows. ``count_sum`` adds up the counts of a row's links,
    ``n_best`` says how many of them have the highest count of their B id. ``groups_sha256`` is
    the hash of the groups as text. A NULL or empty text, and one whose bytes don't come back
    from A's or B's tokens (it holds the character that stands for a space in B), has no
    tokens: zeros and an empty hash. Repeated rows, and rows with a NULL id, are counted and
    returned as any other; an empty table gives no rows. Whole texts are held one at a time.
    """
    spark = docs.sparkSession
    a_path, b_path = a_vocabulary or default_vocabulary(), b_pieces or default_pieces()
    maps = Aligner(a_path, b_path)
    same, size_b = maps.same, maps.size_b
    rows = stored(measured(docs.select(F.col(id_col).cast("long").alias("id"),
                                       F.col(text_col).alias("text")), a_path, b_path),
                  "align-rows", compression="zstd")
    totals = stored(pair_counts(rows, same, size_b), "align-totals")
    b_id = F.col("pair") % size_b
    best = totals.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    links = totals.agg(F.sum("odd")).first()[0] or 0
    often = F.col("odd") * frequent >= max(links, 1)

    # At most a vocabulary of rows each, and at most ``frequent`` pairs.
    most = np.zeros(size_b, np.int64)
    found = best.toArrow()
    most[found["b"].to_numpy()] = found["most"].to_numpy()
    found = totals.where("plain").select("pair", "n").toArrow()
    plain = np.zeros(len(same), np.int64)
    plain[found["pair"].to_numpy() // size_b] = found["n"].to_numpy()
    found = totals.where(often).select("pair", "n").toArrow()
    order = np.argsort(found["pair"].to_numpy())
    keys, counts = (found[c].to_numpy()[order] for c in ("pair", "n"))
    sent = spark.sparkContext.broadcast(
        (plain, plain == most[same], keys, counts, counts == most[keys % size_b]))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, plain_best, keys, counts, counts_best = sent.value
        for batch in batches:
            n = batch.num_rows
            ids, of = _flat(batch.column(n_columns), "<u4")
            total = _sums(of, plain[ids], n)
            top = np.bincount(of, plain_best[ids], n).astype(np.int64)
            pairs, of = _flat(batch.column(n_columns + 1), "<u8")
            pairs = pairs.astype(np.int64)
            at = np.searchsorted(keys, pairs)
            hit = np.zeros(len(pairs), bool)
            inside = at < len(keys)
            hit[inside] = keys[at[inside]] == pairs[inside]
            total += _sums(of[hit], counts[at[hit]], n)
            top += np.bincount(of[hit], counts_best[at[hit]], n).astype(np.int64)
            rest = np.bincount(of[~hit], minlength=n)
            bounds = np.concatenate([[0], np.cumsum(rest)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], pa.array(top), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs[~hit]))],
                names=[*kept, "n_best", "count_sum", "rest"])

    kept = ["row", "id", *_FIGURES, "groups_sha256"]
    n_columns = len(kept)
    summed = stored(rows.mapInArrow(
        add_up, _MEASURED.split(", regular")[0] + ", n_best long, count_sum long, "
        "rest array<long>"), "align-sums", compression="zstd")
    rare = totals.where(~often & (F.col("odd") > 0)).join(F.broadcast(best), b_id == F.col("b")) \
        .select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("top"))
    more = (
        summed.select("row", F.explode("rest").alias("pair")).join(rare, "pair")
        .groupBy(F.col("row").alias("of")).agg(F.sum("count").alias("more"),
                                               F.count_if("top").alias("more_best"))
    )
    zero = F.lit(0).cast("long")
    return summed.drop("rest").join(more, F.col("row") == F.col("of"), "left").select(
        F.col("id").alias(id_col), *_FIGURES,
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by row; ``of`` ascends."""
    running = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    ends = np.searchsorted(of, np.arange(n + 1))
    return running[ends[1:]] - running[ends[:-1]]
