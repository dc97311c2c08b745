"""SimHash fingerprints and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldgauge.llm import components, queries as q, simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + size]).encode(), seed=42).intdigest()
              for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=2):
    """rows: (id, fingerprint). The component's least id, per row."""
    values = sorted({f for _, f in rows})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f, least.get(find(f))) for i, f in rows]


def check(rows, docs):
    wanted = plain_components([(d.doc_id, plain_fingerprint(d.text)) for d in docs])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows), key=key) \
        == sorted(wanted, key=key)


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.001",
                                    "/root/testdata/sf0.01"])
def test_whole_table(spark, tables, folder):
    folder = tables if folder == "awkward" else folder
    check(q.queries()["op12_simhash"](spark, folder).collect(),
          spark.read.parquet(f"{folder}/documents.parquet").collect())


def test_nameless(spark, nameless):
    check(simhash.simhash_components(nameless).collect(), nameless.collect())
    alone = nameless.where("doc_id IS NULL")
    assert [r.component_id for r in simhash.simhash_components(alone).collect()] == [None]


def test_parts_of_a_long_text(monkeypatch):
    words = [str(i * i % 997).encode() for i in range(5000)]
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "_WORDS", 7)
    assert simhash.fingerprint(words) == whole == plain_fingerprint(b" ".join(words).decode())


@pytest.mark.parametrize("distance,segments", [(2, 5), (2, 7), (2, 3), (3, 6), (1, 4), (0, 2)])
def test_ring_misses_no_pair(distance, segments):
    draw = random.Random(segments)
    ring = simhash.Ring(distance, segments)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, distance)):
            b ^= 1 << bit
        meeting = [start for start, mask in ring.keys() if a & mask == b & mask]
        chains = [all(sum(((a ^ b) & ring.masks[s]).bit_count()
                          for s in ring.chain(start)[:length]) <= budget
                      for length, budget in enumerate(ring.budgets, 1)) for start in meeting]
        assert any(chains)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_dense_groups(spark, most):
    """Hundreds of fingerprints within few bits of each other, and chains of them."""
    draw, values = random.Random(1), set()
    for _ in range(4):
        middle = draw.getrandbits(64)
        values.add(middle)
        for _ in range(150):
            near = middle
            for bit in draw.sample(range(20), draw.randint(1, 4)):
                near ^= 1 << bit
            values.add(near)
    step = draw.getrandbits(64)
    for i in range(0, 60, 2):
        step ^= 3 << i
        values.add(step)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    known = spark.createDataFrame(signed, "fp long")
    pairs = simhash.near_pairs(known, 2, 5, most)
    assert pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()
    roots = {r.id: r.root for r in components.components(pairs).collect()}
    mine, theirs = {}, {}
    for v, (s,) in zip(values, signed):
        mine.setdefault(roots.get(s, s), set()).add(v)
    for i, v, least in plain_components(list(enumerate(values))):
        theirs.setdefault(least, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pairs_stay_in_proportion(spark):
    """A key with very many fingerprints forms no more than a bounded number of pairs each."""
    values = [(v,) for v in range(1 << 12)]
    counts = []
    for n in (1 << 10, 1 << 12):
        counts.append(simhash.near_pairs(spark.createDataFrame(values[:n], "fp long"), 2, 5, 64)
                      .count() / n)
    assert counts[1] < 1.6 * counts[0] and counts[1] < 64


def test_too_many_for_another_distance(spark):
    known = spark.createDataFrame([(v,) for v in range(200)], "fp long")
    with pytest.raises(ValueError):
        simhash.near_pairs(known, 3, 6, 4)


def test_hub_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 3)
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] \
        + [(500, 199), (700, 700)]
    found = {r.id: r.root for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 200)} | {500: 0} | {i: 300 for i in range(301, 341)}
