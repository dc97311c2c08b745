"""Near-duplicate components of SimHash fingerprints, with pigeonring candidates.

A fingerprint's 64 bits are cut into segments that stand in a ring. If two fingerprints differ
in at most t bits, then from some segment on every run of l consecutive segments differs in at
most ``l * t / segments`` bits: the chain of budgets. The budgets of the first segments of a
chain are below one, so these segments are equal; then come segments that differ in one bit at
most between them, so all but one of these are equal too. The equal ones make the keys in
which candidates meet. A pair goes on to the full comparison only if its whole chain from that
segment stays within its budgets.

Pairs of a key are formed only up to a bounded number per fingerprint. Members of a larger key
meet instead at every value within one bit of them, in the bits the key leaves open: two
fingerprints at the same value differ in two bits or fewer, two that differ in at most two bits
share such a value, and a value has few members, whatever the key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import stored
from fieldgauge.llm.components import HUBS, components

BITS = 64
#: Words of a text hashed at a time.
_WORDS = 1 << 16


def fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """Bits set in over half the shingles' hashes. Fewer words than a shingle are one shingle;
    without words no bit is set."""
    if not words:
        return 0
    length = min(size, len(words))
    total = len(words) - length + 1
    votes = np.zeros(BITS, np.int64)
    for first in range(0, total, _WORDS):
        part = words[first:first + _WORDS + length - 1]
        body = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashed = xxhash.xxh64_intdigest
        hashes = np.array([hashed(body[a:b], seed) for a, b in
                           zip(starts.tolist(), ends[length - 1:].tolist())], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs: id, text. Per row: id and fp, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes are lower-cased and split by ASCII rules only.
            found = [fingerprint((t.as_py() or "").encode().lower().split(), size)
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["id", "fp"])
    return docs.select("id", "text").mapInArrow(run, "id long, fp long")


class Ring:
    """Segments of a fingerprint in a ring, and the budgets of a chain of them."""

    def __init__(self, distance: int, segments: int):
        if not distance < segments <= BITS:
            raise ValueError("there must be more segments than differing bits, and at most 64")
        self.segments = segments
        ends = [BITS * (i + 1) // segments for i in range(segments)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip([0, *ends], ends)]
        self.budgets = [length * distance // segments for length in range(1, segments + 1)]

    def chain(self, start: int) -> list[int]:
        return [(start + i) % self.segments for i in range(self.segments)]

    def keys(self) -> list[tuple[int, int]]:
        """(start, bits that are equal) of every key: the segments without a budget, and all but
        one of those that have a budget of one between them."""
        head, single = self.budgets.count(0), self.budgets.count(1)
        out = []
        for start in range(self.segments):
            chain = self.chain(start)
            first, then = chain[:head], chain[head:head + single]
            for left_out in then or [None]:
                equal = [*first, *(s for s in then if s != left_out)]
                out.append((start, sum(self.masks[s] for s in equal)))
        return out

    def within(self, start: Column, differing: Column) -> Column:
        """Whether the chain from ``start`` stays within its budgets."""
        def holds(at: int) -> Column:
            run, mask = F.lit(True), 0
            for segment, budget in zip(self.chain(at), self.budgets):
                mask |= self.masks[segment]
                run = run & (F.bit_count(differing.bitwiseAND(_signed(mask))) <= budget)
            return run
        out = F.lit(False)
        for at in range(self.segments):
            out = F.when(start == at, holds(at)).otherwise(out)
        return out


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def near_pairs(known: DataFrame, distance: int, segments: int, most: int) -> DataFrame:
    """known: distinct fp. Pairs (a, b) that differ in at most ``distance`` bits and connect
    all that such pairs connect: all of them in keys of at most ``most`` members; in larger keys
    those with the least member of a value one bit away, for which ``distance`` must be 2."""
    ring = Ring(distance, segments)
    keys = ring.keys()
    entry = F.explode(F.array(*[
        F.struct(F.lit(i).alias("key"), F.lit(start).alias("start"),
                 F.col("fp").bitwiseAND(_signed(mask)).alias("held"))
        for i, (start, mask) in enumerate(keys)]))
    dealt = known.select("fp", entry.alias("e")).select("fp", "e.*")
    sizes = dealt.groupBy("key", "held").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(dealt.join(sizes, ["key", "held"]), "ring-shared")

    small = shared.where(F.col("n") <= most).select("key", "start", "held",
                                                    F.col("fp").alias("a"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        small.join(small.select("key", "held", F.col("a").alias("b")), ["key", "held"])
        .where("a < b").where(ring.within(F.col("start"), differing))
        .where(F.bit_count(differing) <= distance).select("a", "b")
    )
    if distance != 2:
        if not shared.where(F.col("n") > most).isEmpty():
            raise ValueError("a key has too many fingerprints; raise most or the segments")
        return pairs.distinct()
    # The bits that a key leaves open: the value itself, and with one of them turned.
    turned = F.lit(None).cast("array<long>")
    for i, (_, mask) in enumerate(keys):
        steps = [0, *(1 << b for b in range(BITS) if not mask >> b & 1)]
        turned = F.when(F.col("key") == i, F.array(*map(_signed, steps))).otherwise(turned)
    met = (
        shared.where(F.col("n") > most).select("fp", F.explode(turned).alias("step"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("value")).distinct()
        # At most 65 fingerprints are within one bit of a value.
        .groupBy("value").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
        .select("b", F.explode("all").alias("a")).where("a <> b")
        .where(F.bit_count(differing) <= distance)
    )
    return pairs.unionByName(met.select(F.least("a", "b").alias("a"),
                                        F.greatest("a", "b").alias("b"))).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 3, distance: int = 2, segments: int = 5, most: int = 64
                       ) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id that is reachable
    over fingerprints that differ in at most ``distance`` bits.

    Shingles are runs of ``size`` words of the text with A-Z lower-cased, hashed by XXH64 of
    their UTF-8 with seed 42. NULL counts as the empty text; texts without words have fingerprint
    0, which is linked like any other. Rows with one fingerprint are one node, so copies form no
    pairs. Rows that repeat an id are nodes of their own; a row with a NULL id links others but
    never names a component, so a component of such rows alone has a NULL component_id. An empty
    table gives no rows. A text of any length is hashed in parts.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stored(fingerprints(plain, size), "simhash-rows")
    known = stored(rows.groupBy("fp").agg(F.min("id").alias("least"),
                                          F.count(F.lit(1)).alias("n")), "simhash-known")
    roots = components(near_pairs(known.select("fp"), distance, segments, most), "simhash")
    # Fingerprints with their component's fingerprint, then the least id of that.
    named = known.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, F.col("root") == F.col("of"))
                   .select(F.col("fp").alias("same"), "n", "component_id"), "simhash-named")
    # Fingerprints of over one row in HUBS are fewer than HUBS: their rows need no shuffle.
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HUBS > total
    near, far = F.broadcast(named.where(hot).drop("n")), named.where(~hot).drop("n")
    rest = rows.join(near.select("same"), F.col("fp") == F.col("same"), "left_anti")
    out = rows.join(near, F.col("fp") == F.col("same")).unionByName(
        rest.join(far, F.col("fp") == F.col("same")))
    return out.select(F.col("id").alias(id_col),
                      F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
