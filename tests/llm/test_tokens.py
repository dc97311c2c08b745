"""Round trips of the token operators."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldgauge.llm import encoding, packing, pieces, queries as q, wavelet, wordpiece

PATH = encoding.default_vocabulary()


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_like_the_library(plain):
    draw = np.random.default_rng(2)
    marks = [" ", "  ", "\n", " \n", "\t", " ", "\x1c", " ", "'s", "<|endoftext|>", "a",
             "é", "中", "9", "!", "b c", "​", "\x85", "'ll", "\'", "Ж", "×", "́", "\u2003", "\u3000",
             "\r\n", "word", "\x1f", "²", "a very-long.piece_without" * 3, "\0"]
    texts = ["".join(draw.choice(marks, int(draw.integers(0, 30)))) for _ in range(400)] + [""]
    encoder = encoding.Encoder(PATH)
    for _ in range(2):  # the second time from what is kept
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
        assert got == [plain(t) for t in texts]


def test_piece_table_when_crowded(plain, monkeypatch):
    """Full slots, two pieces of one hash, and a table that is emptied between blocks."""
    monkeypatch.setattr(pieces.PieceTable, "SLOT_BITS", 9)
    monkeypatch.setattr(pieces.PieceTable, "BLOCK", 64)
    monkeypatch.setattr(pieces, "_hash", lambda low, high, size: low % np.uint64(3) << np.uint64(62))
    encoder = encoding.Encoder(PATH)
    encoder._table.most = 100
    texts = [" ".join(f"w{i * k % 97}" for i in range(150)) + "\nZ" for k in (1, 5, 7, 11)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [
        plain(t) for t in texts]
    assert encoder._table.count < 400


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.001"])
def test_shards_round_trip(spark, tables, plain, folder):
    folder = tables if folder == "awkward" else folder
    rows = sorted(q.queries()["op5_wavelet_shards"](spark, folder).collect(),
                  key=lambda r: (r.start, r.doc_id))
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(),
                  key=lambda r: r.doc_id)
    at = 0
    for row, doc in zip(rows, docs, strict=True):
        ids = plain(doc.text) + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (
            doc.doc_id, at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000, 65535, 65536, 70000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 40, n).astype(np.uint32)
    blob = wavelet.WaveletMatrix.build(ids, 6).to_bytes()
    matrix = wavelet.WaveletMatrix.from_bytes(blob)
    assert matrix.decode().tolist() == ids.tolist()
    assert matrix.access(np.arange(n)).tolist() == ids.tolist()
    for token in (0, 7, 39, 63, 64):
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.rank(token, n // 2) == (ids[:n // 2] == token).sum()
        if len(places):
            assert matrix.select(token, np.arange(len(places))).tolist() == places.tolist()


def test_few_frames_are_opened():
    ids = np.random.default_rng(1).integers(0, 50000, 400_000).astype(np.uint32)
    blob = wavelet.WaveletMatrix.build(ids, 16).to_bytes()
    matrix = wavelet.WaveletMatrix.from_bytes(blob)
    assert int(matrix.access(123_456)) == ids[123_456]
    assert all(p.opened.sum() <= 2 for p in matrix.planes) and len(matrix.planes[0].opened) == 7
    places = np.flatnonzero(ids == ids[5])
    assert matrix.select(int(ids[5]), np.arange(len(places))).tolist() == places.tolist()
    assert matrix.rank(int(ids[5]), 400_000) == len(places)
    assert (matrix.decode() == ids).all()


def test_small_shards_and_counts(spark, tmp_path, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wavelet.write_shards(docs, str(tmp_path / "s"), shard_tokens=5000)
    shards = wavelet.read_shards(spark, str(tmp_path / "s"))
    assert shards.count() > 10
    back = wavelet.documents_of(shards, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == plain(texts[r.doc_id]) + [2] for r in back)
    counts = wavelet.token_occurrences(shards, [2, 13]).groupBy("token").agg(F.sum("n")).collect()
    every = [i for r in back for i in r.ids]
    assert {tuple(r) for r in counts} == {(t, every.count(t)) for t in (2, 13)}


def greedy(word, pieces, longest):
    text, n = b" " + word, 0
    while text:
        size = next((k for k in range(min(longest, len(text)), 0, -1) if text[:k] in pieces), 0)
        if not size:
            return 1
        text, n = text[size:], n + 1
    return n


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.001"])
def test_counts_like_greedy_matching(spark, tables, folder):
    folder = tables if folder == "awkward" else folder
    pieces = set(wordpiece.vocabulary_pieces(PATH))
    longest, known = max(map(len, pieces)), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in q.queries()["op8_token_counts"](spark, folder).collect():
        words = (texts[r.doc_id] or "").encode().split()
        for w in words:
            if len(w) < 5000 and w not in known:
                known[w] = greedy(w, pieces, longest)
        if all(w in known for w in words):
            assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_automaton_on_small_vocabularies():
    draw = np.random.default_rng(3)
    for _ in range(60):
        pieces = {bytes(draw.choice(list(b"ab"), int(draw.integers(1, 6))).tolist()) for _ in range(6)}
        pieces |= {b" "} if draw.integers(2) else {b" a"}
        matcher = wordpiece.LongestMatch(sorted(pieces))
        for _ in range(40):
            letters = list(b"abc" if draw.integers(9) == 0 else b"ab")
            word = bytes(draw.choice(letters, int(draw.integers(1, 14))).tolist())
            assert matcher[word] == greedy(word, pieces, 9), (pieces, word)


def test_cutting_plan():
    plan = packing.cutting_plan(1024, 8)
    for n in [1, 7, 511, 512, 700, 1023, 1024, 1025, 5000]:
        pieces = packing.cut(n, 1024, plan)
        assert sum(pieces) == n and all(1024 % p <= 8 for p in pieces)


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.01"])
def test_packing(spark, tables, plain, folder, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    folder = tables if folder == "awkward" else folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.packed(docs.repartition(7), with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, pieces in by_doc.items():
        ids = plain(texts[doc]) + [0]
        held = sorted(pieces, key=lambda r: r.start)
        if folder == tables and doc == 6:  # stands twice
            held = held[::2]
        assert [i for r in held for i in np.frombuffer(r.ids, "<u4")] == ids
        assert all(r.doc_tokens == len(ids) for r in held)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    padding = sum(1024 - n for n in lengths if n & (n - 1))
    assert max(lengths) <= 1024 and padding < 0.01 * 1024 * len(lengths)
