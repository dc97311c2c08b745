"""Token ids in wavelet-matrix shards: one compressed file that answers access, rank and select.

A shard holds whole documents. Its ids are stored as bit planes, the highest bit first; each
plane is a stable partition of the one above by that plane's bit. The ones before every frame and
every block are stored beside the planes: rank reads one block of a plane, select searches the
counts first. Frames are compressed one by one and opened when first read, so access, counting
and occurrence lookup open at most one or two frames per plane and position. Shards are rows of a
Parquet table, written and read by Spark, so they work on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgauge.llm.encoding import default_vocabulary, encoder, text_runs

#: Bits of a block, whose ones before it are stored, and of a frame, compressed by itself.
BLOCK, FRAME = 512, 1 << 16
_WORDS = BLOCK // 64
_HEAD = struct.Struct("<4sHHQ")
_MAGIC = b"WVM2"


class _Plane:
    """The 64-bit words of one bit plane; compressed frames are opened when first read."""

    def __init__(self, words: np.ndarray, frames: list[bytes] | None = None):
        self._words, self._frames = words, frames
        self.opened = np.full(-(-len(words) // (FRAME // 64)), frames is None)

    def _open(self, frames: np.ndarray) -> None:
        for f in frames[~self.opened[frames]].tolist():
            body = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._frames[f]), "<u8")
            self._words[f * (FRAME // 64):][:len(body)] = body
            self.opened[f] = True

    def at(self, index: np.ndarray) -> np.ndarray:
        self._open(np.unique(index // (FRAME // 64)))
        return self._words[index]

    def whole(self) -> np.ndarray:
        self._open(np.arange(len(self.opened)))
        return self._words


class WaveletMatrix:
    """A sequence of unsigned integers below 2**bits."""

    def __init__(self, n: int, planes: list[_Plane], zeros: list[int], before: np.ndarray):
        self.n, self.planes, self.zeros, self.before = n, planes, zeros, before

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        values, planes, zeros = ids.astype(kind), [], []
        blocks = len(ids) // BLOCK + 1
        before = np.zeros((bits, blocks + 1), np.int64)
        for level in range(bits - 1, -1, -1):
            one = (values & kind(1 << level)).astype(bool)
            packed = np.zeros(blocks * (BLOCK // 8), np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view("<u8")
            before[bits - 1 - level, 1:] = np.cumsum(
                np.bitwise_count(words).reshape(-1, _WORDS).sum(1, dtype=np.int64))
            planes.append(_Plane(words))
            # Places first, then a take: many times faster than a mask of random bits.
            rest = values.take(np.flatnonzero(~one))
            zeros.append(len(rest))
            values = np.concatenate([rest, values.take(np.flatnonzero(one))])
        return cls(len(ids), planes, zeros, before)

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        step = FRAME // BLOCK
        frames = [squeeze(words[a:a + FRAME // 64].tobytes())
                  for words in (p.whole() for p in self.planes)
                  for a in range(0, len(words), FRAME // 64)]
        # Ones before every frame, and inside its frame before every block.
        coarse = self.before[:, ::step]
        fine = self.before - np.repeat(coarse, step, axis=1)[:, :self.before.shape[1]]
        counts = squeeze(coarse.astype("<u8").tobytes() + fine.astype("<u2").tobytes())
        return b"".join([
            _HEAD.pack(_MAGIC, len(self.planes), 0, self.n), np.array(self.zeros, "<u8").tobytes(),
            np.array([len(counts), *map(len, frames)], "<u4").tobytes(), counts, *frames])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, bits, _, n = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        blocks = n // BLOCK + 1
        per_plane = -(-blocks * _WORDS // (FRAME // 64))
        at = _HEAD.size
        zeros = np.frombuffer(blob, "<u8", bits, at).astype(int).tolist()
        at += 8 * bits
        sizes = np.frombuffer(blob, "<u4", 1 + bits * per_plane, at).astype(np.int64)
        ends = at + sizes.nbytes // 2 + np.cumsum(sizes)
        counts = zstandard.ZstdDecompressor().decompress(blob[ends[0] - sizes[0]:ends[0]])
        step = FRAME // BLOCK
        coarse = np.frombuffer(counts, "<u8", bits * -(-(blocks + 1) // step)).astype(np.int64)
        fine = np.frombuffer(counts, "<u2", bits * (blocks + 1), coarse.nbytes)
        before = (np.repeat(coarse.reshape(bits, -1), step, axis=1)[:, :blocks + 1]
                  + fine.reshape(bits, -1)) if bits else np.zeros((0, blocks + 1), np.int64)
        frames = [blob[e - s:e] for e, s in zip(ends[1:].tolist(), sizes[1:].tolist())]
        planes = [_Plane(np.zeros(blocks * _WORDS, "<u8"),
                         frames[p * per_plane:(p + 1) * per_plane]) for p in range(bits)]
        return cls(n, planes, zeros, before)

    def _ones(self, level: int, end):
        """Ones of a plane before each position."""
        end = np.asarray(end, np.int64)
        block = end // BLOCK
        at = block[..., None] * _WORDS + np.arange(_WORDS)
        inside = np.clip(end[..., None] - at * 64, 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, np.uint64(2**64 - 1),
                        (np.uint64(1) << (inside % np.uint64(64))) - np.uint64(1))
        words = self.planes[level].at(at)
        return self.before[level][block] + np.bitwise_count(words & mask).sum(-1, dtype=np.int64)

    def access(self, position):
        """The ids at these positions."""
        at = np.asarray(position, np.int64)
        value = np.zeros(at.shape, np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level].at(at // 64) >> (at % 64).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            value = value << 1 | bit.astype(np.int64)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return value

    def _run(self, token: int, start, end) -> tuple:
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (len(self.zeros) - 1 - level) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before a position."""
        if not 0 <= token < 1 << len(self.zeros):
            return 0
        start, end = self._run(token, 0, end)
        return int(end - start)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, level: int, one: int, nth: np.ndarray) -> np.ndarray:
        """Where the nth ones (or zeros) of a plane stand: a search in the stored counts for the
        block, then counts of its words, then the bits of one word."""
        before = self.before[level]
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, nth, side="right") - 1
        words = self.planes[level].at(block[:, None] * _WORDS + np.arange(_WORDS))
        words = words if one else ~words
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = nth - before[block]
        word = (sums <= left[:, None]).sum(1)
        row = np.arange(len(nth))
        left = left - np.where(word > 0, sums[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(1)
        return block * BLOCK + word * 64 + inside

    def select(self, token: int, nth) -> np.ndarray:
        """Positions of the nth occurrences (from 0); all must exist."""
        start, _ = self._run(token, 0, self.n)
        at = int(start) + np.asarray(nth, np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            at = self._place(level, one, at - (self.zeros[level] if one else 0))
        return at

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest: each plane undoes its stable partition."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].whole().view(np.uint8), bitorder="little",
                                count=self.n).view(bool)
            above, zeros = np.empty_like(values), self.zeros[level]
            above[np.flatnonzero(~one)] = values[:zeros]
            above[np.flatnonzero(one)] = values[zeros:] | kind(1 << (len(self.zeros) - 1 - level))
            values = above
        return values


SHARDS = ("part int, shard int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, "
          "matrix binary")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, end_id: int = 2,
                 shard_tokens: int = 1 << 20) -> None:
    """Encode every text, close it with ``end_id`` and write the shards in ascending id order.

    A shard closes at the first document that takes it to ``shard_tokens``; a document is
    never cut. NULL ids stand first, rows with one id in the order of their texts' hashes, NULL
    texts as empty ones. The text is shuffled once, by ranges of the id, before it is encoded.
    """
    tokens_path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        close = np.array([end_id], "<u4").tobytes()
        encoded = encoder(tokens_path)
        bits = max(encoded.size - 1, end_id).bit_length()
        ids: list = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            lengths = [len(b) // 4 for b in held]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([len(flat)], pa.int64()),
                pa.array([WaveletMatrix.build(flat, bits).to_bytes()], pa.binary())],
                names=["part", "shard", "doc_ids", "doc_tokens", "n_tokens", "matrix"])

        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                for i, body in enumerate(encoded.encode(texts)):
                    ids.append(batch.column(0)[first + i].as_py())
                    held.append(body + close)
                    total += len(body) // 4 + 1
                    if total >= shard_tokens:
                        yield row()
                        shard, total = shard + 1, 0
                        ids.clear()
                        held.clear()
        if held:
            yield row()

    order = [F.col("id").asc_nulls_first(), F.col("draw")]
    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                 F.xxhash64(F.col(text_col)).alias("draw"))
     .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
     .mapInArrow(encode, SHARDS).write.option("compression", "none").parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def documents_of(shards: DataFrame, id_name: str = "doc_id", with_ids: bool = False
                 ) -> DataFrame:
    """Per document, decoded from the shards: id, start (ids before it in all shards),
    n_tokens, ids_crc32 and, on demand, the ids."""
    extra = ", ids array<long>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, docs, lengths, _, blob = (c[row].as_py() for c in batch.columns)
                ids = WaveletMatrix.from_bytes(blob).decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.tobytes()
                sums = [zlib.crc32(raw[a * 4:b * 4]) for a, b in zip(starts, ends)]
                n = len(docs)
                columns = [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()),
                           pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                           pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "shard", id_name, "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b] for a, b in zip(starts, ends)],
                                            pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = shards.mapInArrow(
        decode, f"part int, shard int, `{id_name}` long, inner long, n_tokens long, "
        "ids_crc32 long" + extra)
    before = (Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "n_tokens")
    # One row per part in the first window, the shards of one part in the second.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(*before)), F.lit(0))
    bases = sizes.join(parts, "part").select(
        "part", "shard", (F.col("base") + inside).alias("base"))
    out = [id_name, (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(bases, ["part", "shard"]).select(*out, *(["ids"] if with_ids else []))


def token_occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Per shard and token its count, by rank on the bit planes; nothing is decoded."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, blob = (c[row].as_py() for c in batch.columns)
                matrix = WaveletMatrix.from_bytes(blob)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(tokens), pa.int32()),
                    pa.array([shard] * len(tokens), pa.int32()), pa.array(tokens, pa.int64()),
                    pa.array([matrix.count(t) for t in tokens], pa.int64())],
                    names=["part", "shard", "token", "n"])
    return shards.select("part", "shard", "matrix").mapInArrow(
        count, "part int, shard int, token long, n long")
