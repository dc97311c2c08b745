"""Signatures against exact similarity, classes against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from fieldgauge.llm import bagminhash, near_dedup
from fieldgauge.llm.common import mix


def bag(text, size=5):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def alike(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def brute_classes(rows, threshold=0.8):
    """The least id of every id's class, by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    bags = {i: bag(t) for i, t in rows}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(root)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if texts[i] == texts[j] or alike(bags[i], bags[j]) >= threshold - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_signatures_are_unbiased():
    draw, errors = np.random.default_rng(0), []
    for turn in range(12):
        a = Counter(draw.integers(0, 60, 200).tolist())
        b = a + Counter({int(k): int(draw.integers(1, 40)) for k in draw.integers(0, 60, 20)})
        elements = np.array([*sorted(a), *sorted(b)], np.uint64) + np.uint64(1000 * turn)
        weights = np.array([a[k] for k in sorted(a)] + [b[k] for k in sorted(b)])
        doc = np.array([0] * len(a) + [1] * len(b))
        s = bagminhash.signatures(mix(elements), weights, doc, 2, 512)
        errors.append((s[0] == s[1]).mean() - alike(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_signature_of_a_text_stands_alone():
    elements = mix(np.arange(30, dtype=np.uint64))
    weights = np.arange(1, 31)
    alone = bagminhash.signatures(elements, weights, np.zeros(30, int), 1, 64)
    beside = bagminhash.signatures(np.concatenate([elements[:3], elements]),
                                   np.concatenate([[9, 9, 9], weights]),
                                   np.array([0] * 3 + [1] * 30), 2, 64)
    assert np.array_equal(alone[0], beside[1])
    assert np.isinf(bagminhash.signatures(elements[:0], weights[:0], np.zeros(0, int), 1, 8)).all()


def test_shingles_of_short_texts():
    data = np.frombuffer(b"a b.A B.a b c d e.  .", np.uint8).copy()
    offsets = np.array([0, 4, 8, 18, 21])
    data[[3, 7, 17]] = 0x20
    found, counts, of = near_dedup.shingles(data, offsets, 5)
    assert of.tolist() == [0, 1, 2, 3] and found[0] == found[1] and counts.tolist() == [1] * 4


@pytest.fixture(scope="module")
def families():
    """Groups of near copies at many distances, beside unrelated texts and exact copies."""
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for family in range(12):
        base = [f"w{draw.integers(5000)}" for _ in range(int(draw.integers(12, 120)))]
        for _ in range(int(draw.integers(2, 14))):
            words = list(base)
            for _ in range(int(draw.integers(0, 4))):
                words[int(draw.integers(len(words)))] = f"x{draw.integers(9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(n + i, shared + " " + " ".join(f"u{i}v{j}" for j in range(80))) for i in range(20)]
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, None), (601, ""), (602, "a b"),
                                                        (603, "A  b"), (604, "a c")]
    return rows


@pytest.mark.parametrize("spread", [0, 4, 1000])
def test_classes_like_brute_force(spark, families, spread):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    got = near_dedup.near_classes(docs, spread=spread)
    found = {r.doc_id: r.class_id for r in got.collect()}
    assert found == brute_classes(families)
    assert {r.doc_id for r in got.where("kept").collect()} == set(found.values())


def test_chains_of_copies(spark):
    """Each text is like the next one only; the ends are linked through the middle."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"c{k}" for k in range(8 * i)] + words[8 * i:])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert found == brute_classes(rows)


def test_repeated_and_missing_ids(spark, nameless):
    rows = near_dedup.near_classes(nameless).collect()
    assert len(rows) == nameless.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].kept and by[None][0].class_id is None
    assert [r.class_id for r in by[6]] == [6, 6]
    assert by[2][0].class_id == 1 and by[2][0].copies_of == 1 and not by[2][0].kept
    assert by[4][0].class_id == 3  # NULL and the empty text are equal


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 60), (60, 70), (70, 50)]
    links = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.root for r in near_dedup.components(links).collect()}
    assert {found[i] for i in [*range(1, 41), 100]} == {0} and found[60] == found[70] == 50


def test_pairs_in_one_wide_bucket(spark, monkeypatch):
    """Many unlinked texts meet in one band; a few pairs just above the threshold meet in no
    other."""
    monkeypatch.setattr(near_dedup, "CROSS", 4)
    draw, rows = np.random.default_rng(7), []
    for i in range(300):
        words = [f"s{k}" for k in range(40)] + [f"u{i}w{k}" for k in range(60)]
        if i % 30 == 1:  # like the text before but for its last 10 words, moved by a few
            words = rows[-1][1].split()[:-10] + [f"v{i}w{k}" for k in range(int(draw.integers(8, 11)))]
        rows.append((i, " ".join(words)))
    linked = brute_classes(rows)
    docs = spark.createDataFrame(rows, "id long, text string").withColumn(
        "same", near_dedup.text_digest())
    keyed = docs.selectExpr("id", "same", "array(7L, 1000 + id, 2000 + id) AS keys")
    links, roots = near_dedup.near_links(docs, keyed, 5, 0.8, 4)
    found = {r.id: r.root for r in roots.collect()}
    assert sum(i != c for i, c in linked.items()) == 10
    assert {i: found.get(i, i) for i in linked} == linked
    assert 10 <= links.count() <= 20


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_rare_shingles_of_links_meet(spark, families, threshold):
    """Also in multisets, and the place of the first shared shingle bounds what is shared."""
    rows = [r for r in families if r[0] < 500] + [(700, "a b c " * 30), (701, "a b c " * 25)]
    docs = spark.createDataFrame(rows, "id long, text string")
    by = {}
    for r in near_dedup.rare_shingles(docs, 5, threshold).collect():
        by.setdefault(r.id, {})[r.bucket] = r.total, r.at
    bags = {i: bag(t) for i, t in rows}
    for k, (i, _) in enumerate(rows):
        for j, _ in rows[k + 1:]:
            if alike(bags[i], bags[j]) >= threshold:
                both = by[i].keys() & by[j].keys()
                shared = sum((bags[i] & bags[j]).values())
                assert any(min(by[x][b][0] - by[x][b][1] for x in (i, j)) >= shared
                           for b in both)


def test_rings_form_no_product(spark, monkeypatch):
    """Texts just outside a family are not compared with every member of it."""
    n, draw, compared, across = 60, random.Random(12), near_dedup.compared, []

    def counted(pairs, *rest):
        across.append(pairs.where(f"a BETWEEN 1 AND {n} AND b > {n}").count())
        return compared(pairs, *rest)

    monkeypatch.setattr(near_dedup, "compared", counted)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2 * n + 1):
        tail = int(300 * (0.08 if i <= n else 0.14))
        rows.append((i, " ".join(base[:-tail] + [f"x{draw.randrange(10 ** 9)}"
                                                 for _ in range(tail)])))
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert all((classes[i] == 0) == (i <= n) for i in classes)
    assert sum(across) < 4 * len(rows)  # the product would be 30 per row


def test_stage_keeps_a_defined_text_of_a_repeated_id(spark):
    from hashlib import md5
    from fieldgauge.llm import stages
    x, y, z, w = (" ".join(f"{name}{i}" for i in range(40)) for name in "xyzw")
    rows = [(3, x), (5, x), (5, y), (6, z), (6, w), (6, w), (7, None), (8, ""), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stays = sorted((r.doc_id, r.text) for r in stages.one_of_each(spark, docs, "").collect()
                   if r.doc_id is not None)
    least = min((z, w), key=lambda t: md5(t.encode()).hexdigest())
    assert stays == [(3, x), (5, y), (6, least), (7, None)]
