"""The native operators against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import domain_rules, mixing, queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.01"])
def test_rule_figures(spark, tables, folder):
    folder = tables if folder == "awkward" else folder
    texts = Counter((r.doc_id, r.text) for r in
                    spark.read.parquet(f"{folder}/documents.parquet").collect())
    expected = Counter()
    for (doc, text), n in texts.items():
        f = figures(text)
        expected[doc, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]] += n
    rows = q.queries()["op4_domain_rules"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words, r.base_failed) for r in rows) == expected
    assert all(not (r.base_failed and r.kept) for r in rows)


def test_ratio_like_brute_force(spark):
    """One bucket per n-gram of a small corpus; the trusted text is named."""
    texts = ["a b a", "a c", "c c c", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.domain_score for r in domain_rules.domain_verdicts(
        docs, buckets=1 << 20, trusted=F.col("doc_id") == 0).collect()}

    def grams(text):
        w = text.split()
        return w + list(zip(w, w[1:]))
    raw, good = Counter(g for t in texts for g in grams(t)), Counter(grams(texts[0]))

    def share(counts, g):
        return (counts[g] + 0.5) / (sum(counts.values()) + 0.5 * (1 << 20))
    for i, t in enumerate(texts):
        ratios = [math.log(share(good, g) / share(raw, g)) for g in grams(t)]
        assert got[i] == pytest.approx(sum(ratios) / len(ratios) if ratios else 0.0)


def test_verdict_parts_good_from_poor(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = q.queries()["op4_domain_rules"](spark, "/root/testdata/sf0.1") \
        .where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(poor) / len(poor) < 0.1


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        room = left - sum(full.values())
        over = [s for s in rest if room * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: room * weight[s] / total for s in rest}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("folder", ["awkward", "/root/testdata/sf0.01"])
def test_targets_and_copies(spark, tables, folder):
    folder = tables if folder == "awkward" else folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    rows = mixing.balanced_copies(docs).collect()
    sizes = Counter()
    for (doc, text), s in source.items():
        copies = sum(1 for r in docs.collect() if (r.doc_id, r.text) == (doc, text)) \
            if folder == tables else 1
        sizes[s] += copies * len(WORD.findall(text or ""))
    targets, taken, longest = filled(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1


def test_rates_solve_the_dual(spark):
    """Rates are the entropy-closest to 1: exp(tilt * size), or the ceiling, meeting targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in mixing.balanced_copies(docs).collect():
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert sum(r.rate * r.size for r in rows) == pytest.approx(rows[0].target, rel=1e-6)
        tilts = [math.log(r.rate) / r.size for r in rows if r.size and 1e-200 < r.rate < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-9 * max(1, abs(tilts[0])) + 1e-12


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = mixing.balanced_copies(docs).select("doc_id", "taken").collect()
    two = mixing.balanced_copies(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(one) == sorted(two)
