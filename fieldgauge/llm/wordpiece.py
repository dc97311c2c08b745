"""Greedy longest-match token counts in linear time, without building the pieces.

The vocabulary is a trie with failure links: when no longer match exists, the link says where
matching goes on and a precomputed number says how many pieces were finished on the way. A text
is read byte by byte once; no piece is ever formed or looked up twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldgauge.llm.encoding import default_vocabulary

#: Distinct words whose count is kept per worker.
KEPT_WORDS = 500_000


def byte_names() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others in turn for code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in names.values()]
    return names | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes."""
    names = byte_names()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return [bytes(names[c] for c in t) for t in tokens if all(c in names for c in t)]


class LongestMatch(dict):
    """Counts of greedy longest pieces, by word; a missing word is run through the automaton.

    A word that no sequence of greedy matches covers counts as one unknown piece.
    """

    def __init__(self, pieces: list[bytes], lead: bytes = b" "):
        super().__init__()
        self.lead = lead
        self.next: dict[int, int] = {}
        depth_order, ends, parents = [0], [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                key = node << 8 | b
                found = self.next.get(key)
                if found is None:
                    found = self.next[key] = len(ends)
                    ends.append(False)
                    parents.append((node, b))
                    depth_order.append(found)
                node = found
            ends[node] = bool(piece)
        depth = [0] * len(ends)
        for node in depth_order[1:]:
            depth[node] = depth[parents[node][0]] + 1
        depth_order.sort(key=depth.__getitem__)
        # link -1: no match can go on. finished: pieces that taking the link completes.
        self.link, self.finished = [-1] * len(ends), [0] * len(ends)
        for node in depth_order[1:]:
            if ends[node]:
                self.link[node], self.finished[node] = 0, 1
                continue
            parent, b = parents[node]
            at, done = self.link[parent], self.finished[parent]
            while at >= 0 and (at << 8 | b) not in self.next:
                done += self.finished[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.finished[node] = self.next[at << 8 | b], done
        # Pieces still to be finished when a word ends in a node; -1: it can't be finished.
        self.closing = [0] * len(ends)
        for node in depth_order[1:]:
            at = self.link[node]
            rest = -1 if at < 0 else self.closing[at]
            self.closing[node] = -1 if rest < 0 else self.finished[node] + rest

    def __missing__(self, word: bytes) -> int:
        follow, link, finished = self.next, self.link, self.finished
        node = count = 0
        for b in self.lead + word:
            found = follow.get(node << 8 | b)
            while found is None:
                count += finished[node]
                node = link[node]
                if node < 0:
                    return 1
                found = follow.get(node << 8 | b)
            node = found
        closing = self.closing[node]
        count = 1 if closing < 0 else count + closing
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = count
        return count


_MATCHERS: dict[str, LongestMatch] = {}


def matcher(path: str) -> LongestMatch:
    """One per worker process, kept from task to task."""
    if path not in _MATCHERS:
        _MATCHERS[path] = LongestMatch(vocabulary_pieces(path))
    return _MATCHERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """Per document: id, n_words (runs without ASCII white space) and n_tokens, the number of
    greedy longest pieces of its words, each read with a space before it.

    A NULL, empty or wordless text has 0 of both. Repeated rows are counted one by one; an
    empty table gives no rows. The vocabulary file must stand on every worker.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = matcher(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                parts = (text.as_py() or b"").split()
                words.append(len(parts))
                tokens.append(sum(map(pieces.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=[id_col, "n_words", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {kind}, n_words long, n_tokens long")
