"""Texts cut into pieces that a byte-level tokenizer encodes one by one, and the ids of pieces met
before, both for a whole batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Kinds of bytes: white space, letter, digit, any other ASCII, part of a longer character.
SPACE, LETTER, DIGIT, MARK, WIDE = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[0x80:] = WIDE
    return kind


def _pairs(*runs: tuple[int, int, int]) -> np.ndarray:
    """Which two bytes in a row are among the runs (first byte, least and greatest second)."""
    inside = np.zeros(1 << 16, bool)
    for first, least, most in runs:
        inside[first << 8 | least:(first << 8 | most) + 1] = True
    return inside


_KIND = _kinds()
#: The last two UTF-8 bytes of white space beyond ASCII (U+0085, A0, 1680, 2000 to
#: 200A, 2028, 2029, 202F, 205F, 3000), and of letters (U+00C0 to FF without the two signs,
#: U+0400 to 047F).
_MAYBE_SPACE = _pairs((0xC2, 0x85, 0x85), (0xC2, 0xA0, 0xA0), (0x9A, 0x80, 0x80),
                      (0x80, 0x80, 0x8A), (0x80, 0xA8, 0xA9), (0x80, 0xAF, 0xAF),
                      (0x81, 0x9F, 0x9F))
_LETTERS = _pairs((0xC3, 0x80, 0x96), (0xC3, 0x98, 0xB6), (0xC3, 0xB8, 0xBF), (0xD0, 0x80, 0xBF),
                  (0xD1, 0x80, 0xBF))
#: First bytes of characters that may be such white space.
_RISKY = np.zeros(256, bool)
_RISKY[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_APOSTROPHE = 0x27


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts laid end to end.

    Every place is one where the byte-level pre-tokenizer starts a pre-token whatever stands
    before it, and before which it needs no look ahead: before a run of white space, after one
    line break or tab that is a run of its own, and between letters, digits and other marks. An
    apostrophe stays with what follows, and characters beyond ASCII are parted only where their
    bytes prove them letters or no white space. So the ids of a text are those of its pieces,
    joined.
    """
    starts = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = _KIND[data]
        prev, here = kind[:-1], kind[1:]
        cut = starts[1:-1]
        np.not_equal(prev, here, out=cut)
        cut &= prev != SPACE
        cut &= (here != WIDE) & ((data[:-1] != _APOSTROPHE) | (here == SPACE))
        wide = np.flatnonzero(cut & (prev == WIDE))
        if len(wide):  # at least two bytes long, so wide >= 1
            pair = data[wide - 1].astype(np.int64) << 8 | data[wide]
            after = here[wide]
            cut[wide] = np.where(after == SPACE, ~_MAYBE_SPACE[pair],
                                 (after != LETTER) & _LETTERS[pair])
    starts[offsets[:-1]] = True
    if len(data):
        lone = np.flatnonzero((prev == SPACE) & (data[:-1] != 0x20) & starts[:-2]
                              & (here != SPACE) & (here != WIDE))
        starts[lone + 1] = True
    return np.flatnonzero(starts[:-1])


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hash(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h ^= (high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


class PieceTable:
    """Ids by piece. Pieces of up to 16 bytes are found by their bytes in an open table, for a
    whole batch at once; longer ones in a dict.

    ``plain`` gives the ids of texts (list of str to list of bytes), ``space`` and ``line`` say
    which ids begin with a space and which is the line break. The table is emptied when it holds
    ``most`` pieces or eight times as many ids, so it takes about 100 MB at two million pieces.
    """

    SLOT_BITS = 22
    #: Pieces looked up at once, and pieces encoded as one text.
    BLOCK, RUN = 1 << 20, 5000

    def __init__(self, plain: Callable[[list[str]], list[bytes]], space: np.ndarray, line: int,
                 most: int = 2_000_000):
        self._plain, self._space, self._line, self.most = plain, space, line, most
        self._clear()

    def _clear(self) -> None:
        self._slots = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self._low, self._high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self._size = np.zeros(1024, np.uint8)
        self._at, self._n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids = np.zeros(4096, np.uint32)
        self._long: dict[bytes, int] = {}
        self.count, self.used = 0, 0

    def encode(self, blobs: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        raw = b"".join([*blobs, bytes(16)])
        data = np.frombuffer(raw, np.uint8)[:len(raw) - 16]
        starts = cut_pieces(data, offsets)
        if not len(starts):
            return [b""] * len(blobs)
        sizes = np.diff(starts, append=len(data))
        parts, totals = [], []
        for a in range(0, len(starts), self.BLOCK):
            if self.count > self.most or self.used > 8 * self.most:
                self._clear()
            found = self._find(raw, starts[a:a + self.BLOCK], sizes[a:a + self.BLOCK])
            n = self._n[found]
            ends = np.cumsum(n)
            from_ = np.repeat(self._at[found] - ends + n, n)
            parts.append(self._ids.take(from_ + np.arange(len(from_))))
            totals.append(n)
        ids, ends = np.concatenate(parts), np.cumsum(np.concatenate(totals))
        before = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(before, before[1:])]

    def _find(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of every piece; unknown ones are encoded and kept first."""
        found = np.empty(len(starts), np.int64)
        short = sizes <= 16
        where = np.flatnonzero(short)
        at, size = starts[where], sizes[where]
        eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = eights[at] & _KEEP[np.minimum(size, 8)]
        high = eights[at + 8] & _KEEP[np.maximum(size - 8, 0)]
        hashes = _hash(low, high, size)
        entry = self._look_up(low, high, size, hashes)
        unknown = np.flatnonzero(entry < 0)
        while len(unknown):
            # Two pieces of one hash: the second one is learned in the next round.
            _, one = np.unique(hashes[unknown], return_index=True)
            new = unknown[one]
            self._keep(low[new], high[new], size[new], hashes[new],
                       self._fresh(raw, at[new], size[new]))
            entry[unknown] = self._look_up(low[unknown], high[unknown], size[unknown],
                                           hashes[unknown])
            unknown = unknown[entry[unknown] < 0]
        found[where] = entry
        rest = np.flatnonzero(~short)
        if len(rest):
            found[rest] = self._long_ones(raw, starts[rest], sizes[rest])
        return found

    def _look_up(self, low, high, size, hashes) -> np.ndarray:
        mask, slot = (1 << self.SLOT_BITS) - 1, (hashes >> np.uint64(64 - self.SLOT_BITS)).astype(
            np.int64)
        entry = self._slots[slot].astype(np.int64)
        same = ((self._low[entry] == low) & (self._high[entry] == high)
                & (self._size[entry] == size))
        open_ = np.flatnonzero(~same & (entry >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & mask
            got = self._slots[slot[open_]].astype(np.int64)
            entry[open_] = got
            same = ((self._low[got] == low[open_]) & (self._high[got] == high[open_])
                    & (self._size[got] == size[open_]))
            open_ = open_[np.flatnonzero(~same & (got >= 0))]
        return entry

    def _add(self, runs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> int:
        """Append ids of n pieces, given as (flat ids, numbers of ids); the first entry."""
        first = self.count
        for name in ("_at", "_n", "_low", "_high", "_size"):
            setattr(self, name, _grown(getattr(self, name), first + n))
        for flat, lengths in runs:
            self._ids = _grown(self._ids, self.used + len(flat))
            self._ids[self.used:self.used + len(flat)] = flat
            here = slice(self.count, self.count + len(lengths))
            self._n[here] = lengths
            self._at[here] = self.used + np.cumsum(lengths) - lengths
            self.count, self.used = here.stop, self.used + len(flat)
        return first

    def _keep(self, low, high, size, hashes, runs) -> None:
        order, runs = runs
        first = self._add(runs, len(low))
        here = slice(first, self.count)
        self._low[here], self._high[here], self._size[here] = low[order], high[order], size[order]
        mask = (1 << self.SLOT_BITS) - 1
        slot = (hashes[order] >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        number = np.arange(first, self.count, dtype=np.int32)
        while len(number):
            free = np.flatnonzero(self._slots[slot] < 0)
            self._slots[slot[free]] = number[free]
            left = np.flatnonzero(self._slots[slot] != number)
            slot, number = slot[left] + 1 & mask, number[left]

    def _long_ones(self, raw: bytes, starts, sizes) -> np.ndarray:
        pieces = [raw[a:a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
        new = {p: i for i, p in enumerate(pieces) if p not in self._long}
        extra: dict[bytes, int] = {}
        if new:
            which = np.fromiter(new.values(), np.int64, len(new))
            order, runs = self._fresh(raw, starts[which], sizes[which])
            first = self._add(runs, len(which))
            extra = {pieces[which[k]]: first + i for i, k in enumerate(order.tolist())}
            # Very long pieces hardly come again.
            self._long.update((p, e) for p, e in extra.items() if len(p) <= 64)
        return np.array([extra[p] if p in extra else self._long[p] for p in pieces], np.int64)

    def _fresh(self, raw: bytes, starts, sizes):
        """The ids of distinct pieces by the library: an order of them, and in that order runs of
        (flat ids, numbers of ids). Words after one space go to the library as one text, told
        apart again by the ids that begin with a space; pieces without white space as its lines."""
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(sizes)
        flat = data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
        safe = ~np.logical_or.reduceat(_RISKY[flat], ends - sizes)
        lead, second = _KIND[data[starts]], _KIND[data[starts + 1]]
        spaced = safe & (data[starts] == 0x20) & (sizes > 1) & (second != SPACE)
        lines = safe & (lead != SPACE)
        groups = [np.flatnonzero(spaced), np.flatnonzero(lines), np.flatnonzero(~spaced & ~lines)]

        def bodies(which: np.ndarray) -> list[bytes]:
            return [raw[a:a + n] for a, n in zip(starts[which].tolist(), sizes[which].tolist())]

        def singly(which: np.ndarray):
            got = self._plain([b.decode() for b in bodies(which)])
            return (np.frombuffer(b"".join(got), "<u4"),
                    np.array([len(g) // 4 for g in got], np.int64))

        def runs():
            for kind, group in enumerate(groups):
                for a in range(0, len(group), self.RUN):
                    which = group[a:a + self.RUN]
                    if kind == 2:
                        yield singly(which)
                        continue
                    joint = b"\n" if kind else b""
                    text = joint + joint.join(bodies(which))
                    ids = np.frombuffer(self._plain([text.decode()])[0], "<u4")
                    begins = ids == self._line if kind else self._space[ids]
                    place = np.flatnonzero(begins)
                    if len(place) != len(which):
                        yield singly(which)
                    else:
                        yield (ids[~begins] if kind else ids,
                               np.diff(place, append=len(ids)) - kind)

        return np.concatenate(groups), runs()
