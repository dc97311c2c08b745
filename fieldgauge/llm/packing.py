"""Harmonic packing of documents into sequences of a fixed length.

A length belongs to the class k of the largest share 1/k of the capacity that holds it, and a
bin of class k takes exactly k pieces, so bins are filled without looking at their contents.
Documents are cut into full sequences and pieces that fill their share up to a few tokens.
Every worker fills its bins alone. Pieces of bins that a worker could not finish are merged in
groups of workers, step by step, until one group is left; its last pieces, under one bin per
class, are laid end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import stored
from fieldgauge.llm.encoding import default_vocabulary, encoder, text_runs

#: Workers whose open bins are merged in one step.
MERGED = 64
PIECES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def cutting_plan(capacity: int, slack: int) -> list[int]:
    """For each length the first piece to cut from it: the longest of which a bin holds so
    many that at most ``slack`` tokens stay free. A length up to ``slack`` is its own piece."""
    plan, best = [0], 0
    for length in range(1, capacity + 1):
        if capacity % length <= slack:
            best = length
        plan.append(best)
    return plan


def cut(tokens: int, capacity: int, plan: list[int]) -> list[int]:
    """Piece lengths of a document, in order."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        pieces.append(plan[rest])
        rest -= plan[rest]
    return pieces


class Bins:
    """Open bins by class. ``add`` gives the pieces of a bin when it is full."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def add(self, piece: list) -> list[list]:
        """piece: a list in the order of PIECES whose sequence and offset are set here."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.close(held)

    def close(self, pieces: list[list]) -> list[list]:
        at = 0
        for piece in pieces:
            piece[5], piece[6] = self.next_id, at
            at += piece[2]
        self.next_id += 1
        return pieces

    def left(self) -> list[list]:
        return [p for k in sorted(self.open) for p in self.open[k]]


def end_to_end(pieces: list[list], bins: Bins, ids_of) -> list[list]:
    """The last pieces one after another, cut at the capacity; what remains after the last
    full sequence goes to sequences whose lengths are powers of two. ``ids_of`` gives the
    checksum of a part."""
    capacity, rest = bins.capacity, sum(p[2] for p in pieces)
    sizes = [capacity] * (rest // capacity)
    rest %= capacity
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, run = [], []
    room = sizes.pop(0) if sizes else 0
    for piece in pieces:
        taken = 0
        while taken < piece[2]:
            length = min(room, piece[2] - taken)
            raw = piece[7][taken * 4:(taken + length) * 4]
            run.append([piece[0], piece[1] + taken, length, ids_of(raw), piece[4], 0, 0, raw])
            taken, room = taken + length, room - length
            if not room:
                out += bins.close(run)
                run, room = [], sizes.pop(0) if sizes else 0
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, end_id: int = 0, capacity: int = 1024,
           slack: int = 8, with_ids: bool = False) -> DataFrame:
    """Every document's pieces and their places in the sequences.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on demand, the
    piece's ids (``ids``, little-endian unsigned 32-bit). A document is its ids and ``end_id``;
    a NULL or empty text is ``end_id`` alone. Each id lies in one piece; a sequence has no gaps
    and at most ``capacity`` ids. Repeated rows are packed as documents of their own; an empty
    table gives no rows. ``docs`` should be read from a table, so that a task that runs again
    meets the same rows.
    """
    path = vocabulary or default_vocabulary()
    plan = cutting_plan(capacity, slack)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = (f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, ids binary, worker long")
    names = [*PIECES, "worker"]

    def columns(rows: list[list], worker: int, id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array([worker] * len(rows), pa.int64())], names=names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        bins, close = Bins(capacity, worker << 32), np.array([end_id], "<u4").tobytes()
        encoded, out, id_type = encoder(path), [], pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for first, texts in text_runs(batch.column(1)):
                for i, raw in enumerate(encoded.encode(texts)):
                    raw += close
                    key, total, at = batch.column(0)[first + i].as_py(), len(raw) // 4, 0
                    for length in cut(total, capacity, plan):
                        ids = raw[at * 4:(at + length) * 4]
                        out += bins.add([key, at, length, zlib.crc32(ids), total, None, None,
                                         ids])
                        at += length
                if len(out) > 5000:
                    yield columns([_light(p, with_ids) for p in out], worker, id_type)
                    out = []
        out = [_light(p, with_ids) for p in out] + bins.left()
        if out:
            yield columns(out, worker, id_type)

    def merge(final: bool, step: int):
        def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
            bins = Bins(capacity, step << 56 | int(key[0]) << 32)
            order = pieces.sort_values(["worker", "length", "ids_crc32", "start"],
                                       kind="stable")
            out = []
            for piece in order[PIECES].astype(object).values.tolist():
                out += bins.add(piece)
            if final:
                out += end_to_end(bins.left(), bins, zlib.crc32)
                left = []
            else:
                left = bins.left()
            rows = [_light(p, with_ids) for p in out] + [[*p[:5], None, None, p[7]] for p in left]
            # As objects: a column with gaps would become floats and lose digits of long ids.
            frame = pd.DataFrame(rows, columns=PIECES, dtype=object)
            places = dict.fromkeys(PIECES[1:5], "int64") | dict.fromkeys(PIECES[5:7], "Int64")
            return frame.astype(places).assign(worker=int(key[0]))
        return run

    pieces = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                    .mapInArrow(fill, schema), "packing-pieces")
    done = pieces.where("sequence_id IS NOT NULL")
    left, step = pieces.where("sequence_id IS NULL"), 1
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    while True:
        workers = -(-workers // MERGED)
        merged = stored(
            left.withColumn("group", F.floor(F.col("worker") / MERGED)).groupBy("group")
            .applyInPandas(merge(workers == 1, step), schema), "packing-merged")
        done = done.unionByName(merged.where("sequence_id IS NOT NULL"))
        if workers == 1:
            break
        left, step = merged.where("sequence_id IS NULL"), step + 1
    out = [F.col("id").alias(id_col), *PIECES[1:7], *(["ids"] if with_ids else [])]
    return done.select(*out)


def _light(piece: list, with_ids: bool) -> list:
    """A finished piece needs its ids no more, unless they are asked for."""
    return piece if with_ids else [*piece[:7], None]
