"""BagMinHash signatures: minima of Poisson processes over the weights of a multiset.

Weights are whole numbers, cut into blocks (0,1], (1,2], (2,4], (4,8] and so on. Every element
has a Poisson process per block, with a rate of the block's width for each of the m places of
the signature. Its points come in ascending order, each with a place and a weight inside the
block; a point counts for a multiset that holds the element with more than that weight, so
larger weights see a superset of the points of smaller ones. The signature keeps the least
point of every place. Two signatures agree in a place with the weighted Jaccard similarity.

A process is left as soon as its next point lies beyond the largest value in the signature, so
the work per text is about m log m points and one per element, whatever the weights are.
"""

from __future__ import annotations

import numpy as np

from fieldgauge.llm.common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int,
               places: int) -> np.ndarray:
    """A row of ``places`` values per text; elements of one text must be distinct.

    A text without elements has infinity everywhere.
    """
    out = np.full(docs * places, np.inf)
    blocks = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(int) + 1)
    row = np.repeat(np.arange(len(elements)), blocks)
    block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    base = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.maximum(base, 1)
    state = mix(elements[row] + mix(block.astype(np.uint64)))
    held, of = weights[row], doc[row]
    at = np.zeros(len(row))
    while len(at):
        state = state + _STEP
        draw = mix(state)
        # 32 bits for the gap, 32 for the place; a second draw for the weight where it matters.
        gap = -np.log(((draw >> np.uint64(32)).astype(float) + 0.5) / 2.0 ** 32)
        at = at + gap / (places * width)
        place = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places) >> np.uint64(32)).astype(int)
        counts = np.ones(len(at), bool)
        wide = np.flatnonzero(width > 1)
        if len(wide):
            level = (mix(draw[wide] ^ _STEP) >> np.uint64(11)).astype(float) / 2.0 ** 53
            counts[wide] = base[wide] + np.floor(level * width[wide]) < held[wide]
        np.minimum.at(out, (of * places + place)[counts], at[counts])
        worst = out.reshape(docs, places).max(1)
        live = at < worst[of]
        state, at, of, held = state[live], at[live], of[live], held[live]
        width, base = width[live], base[live]
    return out.reshape(docs, places)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of equally many places."""
    rows = signature.shape[1] // bands
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(-1, bands, rows)
    key = mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]))
    for r in range(rows):
        key = mix(key * _STEP + bits[:, :, r])
    return key.view(np.int64)
