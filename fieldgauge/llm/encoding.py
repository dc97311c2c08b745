"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import os

import numpy as np

from fieldgauge.llm.pieces import PieceTable

#: White space as the tokenizers library sees it, inside a character class; the
#: four separators 1C to 1F are white space to Python alone.
GAP, INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, by a byte-level vocabulary
    with the library's own byte-level pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.vocabulary = vocabulary = self._tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        #: Per first character of a piece, the ids that begin with it.
        self._leads = {}
        for first, shown in ((" ", "Ġ"), ("\n", "Ċ")):
            self._leads[first] = np.zeros(self.size, bool)
            self._leads[first][[i for t, i in vocabulary.items() if t.startswith(shown)]] = True
        self._table = PieceTable(self._plain, self._leads[" "], vocabulary.get("Ċ", -1))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in
                self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, each as a text of its own. Pieces that begin with the same
        character, and hold it only there, go as one text, which is told apart again by the
        ids that begin with it."""
        out: dict[str, bytes] = {}
        for first, leads in self._leads.items():
            alike = [p for p in pieces if p.startswith(first) and len(p) > 1
                     and not p[1].isspace() and first not in p[1:]]
            for i in range(0, len(alike), 5000):
                run = alike[i:i + 5000]
                joined = self._plain(["".join(run)])[0]
                starts = np.flatnonzero(leads[np.frombuffer(joined, "<u4")])
                if len(starts) == len(run):
                    at = [*(starts * 4).tolist(), len(joined)]
                    out.update((p, joined[a:b]) for p, a, b in zip(run, at, at[1:]))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self._plain(rest)))
        return [out[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, from the pieces met before."""
        return self._table.encode([t.encode() for t in texts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_runs(texts, most_chars: int = 1 << 20, most_texts: int = 256):
    """Runs of an Arrow text column as (first, list of str); NULL is empty."""
    run, first, chars = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if run and (chars + len(t) > most_chars or len(run) >= most_texts):
            yield first, run
            run, first, chars = [], i, 0
        run.append(t)
        chars += len(t)
    if run:
        yield first, run
