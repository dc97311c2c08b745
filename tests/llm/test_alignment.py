"""Alignment of two tokenizers against one that compares every pair of tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldgauge.llm import alignment, queries as q
from fieldgauge.llm.encoding import default_vocabulary


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def plain_alignment(tokenizers, texts):
    """Per text the contract's figures, token by token over whole texts."""
    a, b = tokenizers
    bytes_a = alignment.byte_level_bytes(a.get_vocab())
    bytes_b = alignment.piece_bytes(b)

    def ends(ids, table):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        return out

    found, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in ids_a) != whole \
                or b"".join(bytes_b[i] for i in ids_b) != whole:
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = ends(ids_a, bytes_a), ends(ids_b, bytes_b)
        links, low = [], 0
        for i, end in enumerate(ends_a):
            start = end - len(bytes_a[ids_a[i]])
            while ends_b[low] <= start:
                low += 1
            j = low
            while j < len(ends_b) and ends_b[j] - len(bytes_b[ids_b[j]]) < end:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:u])) + "|" + ",".join(map(str, ids_b[j:v])))
            i, j = u, v
        counts.update(links)
        found.append((ids_a, ids_b, groups, links))
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return [(len(x), len(y), len(groups), len(links),
             sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for x, y, groups, links in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_like_token_by_token(spark, tokenizers):
    draw = np.random.default_rng(5)
    marks = [" ", "  ", "\n", " \n", "\t", "\x1c", "\xa0", "'s", "<|endoftext|>", "<s>", "a",
             "é", "中", "9", "!", "tion", "straße", "​", "\x85", "\x00", "the", "2024", "<0x41>"]
    texts = ["".join(draw.choice(marks, int(draw.integers(0, 40)))) for _ in range(300)]
    texts += [None, "", " ", "  ", "a ", " a", "mark ▁ of a space", "▁", "words " * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = plain_alignment(tokenizers, texts)
    for frequent in (1, 20, 1 << 18):  # nearly all pairs joined, some, and none
        rows = {r.doc_id: r for r in alignment.aligned(docs, frequent=frequent).collect()}
        assert [tuple(rows[i][c] for c in COLUMNS) for i in range(len(texts))] == wanted


def test_whole_table(spark, tokenizers):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    wanted = plain_alignment(tokenizers, [d.text for d in docs])
    rows = {r.doc_id: r for r in q.queries()["op11_alignment"](spark, folder).collect()}
    assert [tuple(rows[d.doc_id][c] for c in COLUMNS) for d in docs] == wanted


def test_nameless_rows_count(spark, nameless, tokenizers):
    rows = alignment.aligned(nameless).collect()
    texts = [r.text for r in nameless.collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in rows) == Counter(
        plain_alignment(tokenizers, texts))
    assert sum(r.doc_id is None for r in rows) == 1


def test_cuts_are_forgotten(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_CUTS", 3)
    align = alignment.Aligner(default_vocabulary(), alignment.default_pieces()).align
    texts = ["some words here", "other words there", "some words here"]
    assert [[r[:4] for r in align([t])] for t in texts] == [
        [w[:4]] for w in plain_alignment(tokenizers, texts)]


def test_identity_map():
    same = alignment.identity_map([b" a", b"b", b"", b"zz"], [b"", b"b", b" a", b"b"])
    assert same.tolist() == [2, 3, -1, -1]
