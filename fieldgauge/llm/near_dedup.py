"""Near-duplicate classes: BagMinHash signatures, bands, verified multiset overlap.

Texts are multisets of five-word shingles. Equal texts become one class first. Texts that share
a band of their signatures meet in a bucket; a candidate counts as a link only if the exact
weighted Jaccard similarity of the two multisets reaches the threshold. Classes are the
connected components of the links.

No bucket forms all its pairs: its members are compared with one of them at a time, and the
triangle inequality says which further pairs can matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.bagminhash import band_keys, signatures
from fieldgauge.llm.common import grams, hashed_words, stored, text_chunks
from fieldgauge.llm.components import components

#: Pairs per member up to which the components left in a bucket are compared pair by pair.
CROSS = 32
#: Buckets in which shingles are counted to put the rare ones first.
RARITY = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, size: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts and their texts' numbers, in text order.

    Words are lower-cased (ASCII) runs without white space. A text of fewer words than a
    shingle is one shingle of all its words; a text without words has none.
    """
    words, doc = hashed_words(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    parts = []
    for length in range(1, size + 1):
        fits = counts[doc] >= size if length == size else counts[doc] == length
        found, of = words[fits], doc[fits]
        if length > 1:
            found, of = grams(found, of, tuple(range(1, length)))
        parts.append((found + np.uint64(length), of))
    found, of = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(first)
    return found[starts], np.diff(np.append(starts, len(found))), of[starts]


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
               ) -> float:
    """Weighted Jaccard of two multisets of (sorted hashes, counts)."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    both = np.minimum(left[1][i], right[1][j]).sum()
    total = left[1].sum() + right[1].sum() - both
    return float(both / total) if total else 1.0


def signed(docs: DataFrame, size: int, places: int, bands: int) -> DataFrame:
    """docs: id, text. Per row: id, same (a digest of the text) and its band keys, none
    without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), 1 << 21, 4096):
                found, counts, of = shingles(data, offsets, size)
                n = end - first
                keys = band_keys(signatures(found, counts, of, n, places), bands)
                has = np.bincount(of, minlength=n) > 0
                bounds = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:end], batch.column(2)[first:end],
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                             pa.array(keys[has].reshape(-1)))],
                    names=["id", "same", "keys"])

    return docs.select("id", "text", text_digest()).mapInArrow(
        sign, "id long, same string, keys array<long>")


def text_digest():
    return F.md5(F.col("text").cast("binary")).alias("same")


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with the exact similarity of their multisets. Each text is fetched by
    joins on its id; a text in very many pairs is a hot key that the joins may split."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, found = {}, np.zeros(batch.num_rows)
            ids = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]

            def bag(side: int, row: int):
                key = ids[side][row]
                if key not in bags:
                    if len(bags) > 2000:
                        bags.clear()
                    data = np.frombuffer((batch.column(2 + side)[row].as_py() or "").encode(),
                                         np.uint8)
                    hashes, counts, _ = shingles(data, np.array([0, len(data)]), size)
                    bags[key] = hashes, counts
                return bags[key]

            for row in range(batch.num_rows):
                found[row] = similarity(bag(0, row), bag(1, row))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)],
                                             names=["a", "b", "alike"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b") \
        .mapInArrow(check, "a long, b long, alike double")


def rare_shingles(texts: DataFrame, size: int, limit: float) -> DataFrame:
    """texts: id, text. Per text, the shingles that can be the first one it shares with a text
    of at least this similarity: id, bucket, total (the multiset's size), at (how much of it
    stands before the shingle).

    Shingles stand in one order for all texts, those in few texts first. Two multisets that
    share ``both`` of their ``total`` have both >= limit * total, and nothing before their first
    shared shingle is shared, so at <= (1 - limit) * total. So every link meets in a bucket,
    whatever the order is; the order only keeps common passages out of the buckets.
    """
    spark, mask = texts.sparkSession, np.uint64(RARITY - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                found = shingles(data, offsets, size)[0]
                total += np.bincount((found & mask).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toArrow()
    often = np.zeros(RARITY, np.int64)
    often[counted["at"].to_numpy()] = counted["n"].to_numpy()
    table = spark.sparkContext.broadcast(often)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                found, counts, of = shingles(data, offsets, size)
                order = np.lexsort((found, table.value[(found & mask).astype(np.int64)], of))
                found, counts = found[order], counts[order]
                before = np.cumsum(counts) - counts
                total = np.bincount(of, counts, end - first).astype(np.int64)
                at = before - (np.cumsum(total) - total)[of]
                use = at <= (1 - limit) * total[of] + 1e-6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end].take(pa.array(of[use])),
                     pa.array(found[use].view(np.int64)), pa.array(total[of][use]),
                     pa.array(at[use])], names=["id", "bucket", "total", "at"])

    return texts.select("id", "text").mapInArrow(
        rare, "id long, bucket long, total long, at long")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of all links so far. roots: (id, root) of earlier links, without the roots
    themselves; links: a, b. Only ties between different components are searched."""
    ties = links.select("a", "b")
    for side in ("a", "b"):
        ties = _rooted(ties, roots, side, f"root_{side}")
    found = stored(components(ties.where("root_a <> root_b").select(
        F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "dedup"),
        "dedup-found-roots")
    moved = roots.join(found.select(F.col("id").alias("old"), F.col("root").alias("new")),
                       F.col("root") == F.col("old"), "left") \
        .select("id", F.coalesce("new", "root").alias("root"))
    return stored(moved.unionByName(found), "dedup-roots")


def _rooted(rows: DataFrame, roots: DataFrame, key: str = "id", out: str = "root"
            ) -> DataFrame:
    """rows with the component of an id; an id without links is its own."""
    named = roots.select(F.col("id").alias("member"), F.col("root").alias(out))
    return rows.join(named, F.col(key) == F.col("member"), "left").drop("member") \
        .withColumn(out, F.coalesce(out, key))


def near_links(docs: DataFrame, keyed: DataFrame, size: int, threshold: float, spread: int
               ) -> tuple[DataFrame, DataFrame]:
    """Compared pairs that are links, and the components of all links.

    docs: id, text, same. keyed: id, same, keys (of bands).

    The members of a bucket are compared with its first member. Those that are not linked to
    it are compared with each other where they belong to different components, if that takes a
    few pairs per member. Else they make the next bucket, with a first member of their own; if
    they are many and over four in five, they are dealt by their rare shingles instead
    (``rare_shingles``), in which every link reappears and chance meetings don't. Buckets of
    rare shingles are not dealt again: what such a one leaves is compared pair by pair, where
    the sizes and the place of the shingle allow a link. What remains is a text x outside the
    first member's links and a text y inside them: by the triangle inequality of the distance
    they can be linked only if x is within twice the allowed distance, and y far enough out; if
    x has not been connected otherwise, those of these pairs that share a rare shingle are
    compared as well. So of two texts that
    share a band, no link that connects two classes is lost.
    """
    spark = keyed.sparkSession
    limit = threshold - 1e-12
    pairs_seen = spark.createDataFrame([], "a long, b long, alike double")
    rings = spark.createDataFrame([], "id long, first long, alike double")
    linked, roots, fresh = rings, spark.createDataFrame([], "id long, root long"), []
    texts = None
    none = F.lit(None).cast("long")
    groups = keyed.select("id", F.explode("keys").alias("bucket"), none.alias("total"),
                          none.alias("at"))

    def compare(pairs: DataFrame) -> None:
        nonlocal pairs_seen
        new = stored(pairs.distinct().join(pairs_seen, ["a", "b"], "left_anti"), "dedup-pairs")
        if not new.isEmpty():
            found = stored(compared(new, texts, size), "dedup-found")
            pairs_seen = pairs_seen.unionByName(found)
            fresh.append(found.where(F.col("alike") >= limit))

    def join_roots() -> None:
        nonlocal roots
        links = [f for f in fresh if not f.isEmpty()]
        fresh.clear()
        if links:
            roots = joined_roots(roots, reduce(DataFrame.unionByName, links))

    while True:
        # Buckets with one member are gone; the others get their size and a first member: the
        # one that meets the most others in all its buckets, as the middle of a family does.
        sizes = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(groups.join(sizes, "bucket"), "dedup-shared")
        met = shared.groupBy(F.col("id").alias("member")).agg(F.sum("n").alias("met"))
        rank = F.col("met") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
        ranked = shared.join(met, F.col("id") == F.col("member")).select(
            "id", "bucket", rank.alias("rank"))
        firsts = ranked.groupBy(F.col("bucket").alias("of")).agg(
            F.max_by("id", "rank").alias("first"))
        members = stored(shared.join(firsts, F.col("bucket") == F.col("of")).drop("of"),
                         "dedup-members")
        if members.isEmpty():
            break
        if texts is None:
            wanted = members.select("id").distinct().join(keyed.select("id", "same"), "id")
            texts = stored(
                docs.join(wanted.select(F.col("id").alias("of"), F.col("same").alias("right")),
                          F.col("id") == F.col("of"))
                .where(F.col("same") == F.col("right")).select("id", "text")
                .dropDuplicates(["id"]), "dedup-texts")
        others = members.where("id <> first")
        compare(others.select(F.least("first", "id").alias("a"), F.greatest("first", "id")
                              .alias("b")))
        join_roots()
        judged = stored(
            others.withColumn("a", F.least("first", "id")).withColumn("b", F.greatest("first", "id"))
            .join(pairs_seen, ["a", "b"]).drop("a", "b"), "dedup-judged")
        by_first = judged.select("id", "first", "alike").distinct()
        rings = rings.unionByName(by_first.where(
            (F.col("alike") < limit) & (F.col("alike") >= 2 * limit - 1)))
        linked = linked.unionByName(by_first.where(F.col("alike") >= limit))
        rest = _rooted(judged.where(F.col("alike") < limit), roots)
        # Only where several components are left can a link be missing. Members of one need
        # no comparing, so what may be left to do is counted in pairs of different ones.
        shape = (
            rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("bucket").agg(F.sum("c").alias("left"), F.sum(F.col("c") * F.col("c"))
                                   .alias("squares"), F.max_by("root", "c").alias("main"))
            .where(F.col("left") * F.col("left") > F.col("squares"))
        )
        rest = stored(rest.join(shape, "bucket"), "dedup-rest")
        cheap = F.col("left") * F.col("left") - F.col("squares") <= 2 * CROSS * F.col("left")
        wide = (F.col("left") > spread) & (F.col("left") * 5 > F.col("n") * 4)
        by_shingle = F.col("at").isNotNull()
        few = rest.where(cheap | (wide & by_shingle)).select(
            "bucket", F.col("id").alias("y"), F.col("root").alias("root_y"), "main",
            F.col("alike").alias("alike_y"), F.col("total").alias("total_y"),
            F.col("at").alias("at_y"))
        minor = few.where("root_y <> main").select(
            "bucket", *[F.col(f"{c}_y").alias(f"{c}_x") for c in ("root", "alike", "total", "at")],
            F.col("y").alias("x"))
        # Nothing before the first shared shingle is shared; NULL in buckets of bands.
        most = F.least(F.col("total_x") - F.col("at_x"), F.col("total_y") - F.col("at_y"))
        fits = most * (1 + limit) >= (F.col("total_x") + F.col("total_y")) * limit
        compare(minor.join(few, "bucket").where(
            (F.col("root_x") != F.col("root_y"))
            & (F.abs(F.col("alike_x") - F.col("alike_y")) <= 1 - limit)
            & F.coalesce(fits, F.lit(True)))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        rest = rest.where(~cheap)
        again = rest.where(~wide).select(
            "id", F.xxhash64("bucket", F.lit("next")).alias("bucket"), "total", "at")
        scattered = stored(rest.where(wide & ~by_shingle).select("id").distinct(),
                           "dedup-scattered")
        groups = again
        if not scattered.isEmpty():
            groups = groups.unionByName(
                rare_shingles(texts.join(scattered, "id", "left_semi"), size, limit))
        groups = stored(groups, "dedup-groups")
    if texts is None:
        return pairs_seen.select("a", "b"), spark.createDataFrame([], "id long, root long")
    join_roots()
    outer = stored(
        _rooted(_rooted(rings.distinct(), roots), roots, "first", "first_root")
        .where("root <> first_root")
        .select(F.col("id").alias("x"), "first", F.col("alike").alias("alike_x")), "dedup-outer")
    if not outer.isEmpty():
        inner = linked.distinct().join(outer.select("first").distinct(), "first", "left_semi") \
            .select(F.col("id").alias("y"), "first", F.col("alike").alias("alike_y"))
        # Two linked texts share one of the shingles that come first in both.
        wanted = outer.select(F.col("x").alias("id")).unionByName(
            inner.select(F.col("y").alias("id"))).distinct()
        rare = stored(rare_shingles(texts.join(wanted, "id", "left_semi"), size, limit),
                      "dedup-rare")
        sides = [side.join(rare.select(F.col("id").alias(name), "bucket",
                                       F.col("total").alias(f"total_{name}"),
                                       F.col("at").alias(f"at_{name}")), name)
                 for side, name in ((outer, "x"), (inner, "y"))]
        most = F.least(F.col("total_x") - F.col("at_x"), F.col("total_y") - F.col("at_y"))
        compare(sides[0].join(sides[1], ["first", "bucket"])
                .where(F.col("alike_y") <= F.col("alike_x") + (1 - limit))
                .where(most * (1 + limit) >= (F.col("total_x") + F.col("total_y")) * limit)
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        join_roots()
    return pairs_seen.where(F.col("alike") >= limit).select("a", "b"), roots


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                 threshold: float = 0.8, bands: int = 64, rows: int = 8, spread: int = 4,
                 with_digest: bool = False) -> DataFrame:
    """Per row: id, class_id (the least id of its class), copies_of (the least id with the same
    text), compared_links (links of that text to different texts, of those that were compared)
    and kept (the row of the class's least id); on demand, digest (MD5 of the text).

    Links hold between texts with a weighted Jaccard similarity of at least ``threshold``. Two
    such texts share none of the bands with a probability of (1 - threshold**rows)**bands, 8e-6
    with these parameters; texts half alike share any with one of 22 %. NULL counts as the empty text; equal texts are one class, and texts
    without words are linked to no other. Rows that repeat an id have one class, that of the
    text with the least digest among those whose least id it is; all rows are returned. A row
    with a NULL id has no class and is kept. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = plain.where("id IS NOT NULL")
    marked = stored(signed(named, size, bands * rows, bands), "dedup-signed")
    # The least id of every text; a group of copies is combined before it is shuffled.
    same = stored(marked.groupBy("same").agg(F.min("id").alias("copies_of")), "dedup-same")
    keyed = stored(
        marked.join(same.select(F.col("same").alias("right"), "copies_of"),
                    (F.col("same") == F.col("right")) & (F.col("id") == F.col("copies_of")))
        .groupBy("id").agg(F.min(F.struct("same", "keys")).alias("least"))
        .select("id", "least.same", "least.keys").where(F.size("keys") > 0), "dedup-keys")
    links, roots = near_links(named.select("id", "text", text_digest()), keyed, size, threshold,
                              spread)
    degree = links.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id") \
        .agg(F.count(F.lit(1)).alias("compared_links"))
    linked = stored(roots.select(F.col("id").alias("text_id"), "root")
                    .join(degree, "text_id", "full"), "dedup-linked")
    classes = (
        marked.select("id", "same").join(same, "same")
        .join(linked, F.col("copies_of") == F.col("text_id"), "left")
        .select("id", "copies_of", F.coalesce("root", "copies_of").alias("class_id"),
                F.coalesce("compared_links", F.lit(0)).cast("long").alias("compared_links"),
                F.col("same").alias("digest"))
    )
    none = F.lit(None).cast("long")
    nameless = plain.where("id IS NULL").select(
        "id", none.alias("copies_of"), none.alias("class_id"),
        F.lit(0).cast("long").alias("compared_links"), text_digest().alias("digest"))
    return classes.unionByName(nameless).select(
        F.col("id").alias(id_col), "class_id", "copies_of", "compared_links",
        F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"),
        *(["digest"] if with_digest else []))
