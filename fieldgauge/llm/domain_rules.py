"""Quality rules and a target-domain verdict, in DataFrame operations only.

The verdict is the log-likelihood ratio of a text's hashed word n-grams under two multinomials,
one counted over trusted texts and one over the raw corpus, divided by the number of n-grams.
A text is kept when the mean ratio reaches a fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import WORD_GAP, stored

#: The characters counted as symbols, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5


def _at(array: str | Column, place: Column) -> Column:
    return F.get(array, place)


def with_words(texts: DataFrame) -> DataFrame:
    """Adds ``words`` (NULL text: none), ``n_words`` and ``hashes``, one hash per word."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), "")
    return (
        texts.withColumn("words", words)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    )


def cheap_rules(worded: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols and n_dup_lines to texts with words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        worded.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols",
                    F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .drop("lines")
    )


def repeat_rule(worded: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that the text holds twice or more.

    A window's hash stands above its position in one long, so one primitive sort brings equal
    windows together; neighbours are then compared by the hashes of their three words. Covered
    words follow from the gaps between the sorted positions.
    """
    bits = "length(bin(n_words))"
    key = ("transform(sequence(0, cast(n_words as int) - 3), i -> "
           "shiftleft(xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]), bits) | i)")
    windows = F.expr(f"CASE WHEN n_words >= 4 THEN sort_array({key}) "
                     "ELSE cast(array() as array<bigint>) END")
    mask = F.expr("shiftleft(1L, bits) - 1")

    def same(x: Column, other: Column) -> Column:
        p, q = x.bitwiseAND(F.col("mask")), other.bitwiseAND(F.col("mask"))
        equal = (x - p) == (other - q)
        for step in range(3):
            equal = equal & (_at("hashes", (p + step).cast("int"))
                             == _at("hashes", (q + step).cast("int")))
        return F.coalesce(equal, F.lit(False))

    repeated = F.filter("windows", lambda x, i: same(x, _at("windows", i - 1))
                        | same(x, _at("windows", i + 1)))
    places = F.array_sort(F.transform("repeated", lambda x: x.bitwiseAND(F.col("mask"))))
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(
            F.lit(3).cast("long"), F.coalesce(_at("places", i + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return (
        worded.withColumn("bits", F.expr(bits)).withColumn("mask", mask)
        .withColumn("windows", windows).withColumn("repeated", repeated)
        .withColumn("places", places).withColumn("n_repeat_words", covered)
        .drop("bits", "mask", "windows", "repeated", "places")
    )


def trusted_texts() -> Column:
    """Texts clear of the base rules by a margin: 50 words or more, under one symbol in a
    hundred words, no repeated line, at least three words in ten distinct."""
    return ((F.col("n_words") >= LEAST_WORDS) & (F.col("n_symbols") * 100 < F.col("n_words"))
            & (F.col("n_dup_lines") == 0)
            & (F.size(F.array_distinct("hashes")) * 10 >= F.col("n_words") * 3))


def gram_buckets(buckets: int) -> Column:
    """The bucket of every word and of every pair of neighbouring words."""
    return F.expr(
        f"concat(transform(hashes, h -> cast(pmod(h, {buckets}) as int)), "
        f"CASE WHEN n_words >= 2 THEN transform(sequence(0, cast(n_words as int) - 2), "
        f"i -> cast(pmod(xxhash64(hashes[i], hashes[i + 1]), {buckets}) as int)) "
        "ELSE cast(array() as array<int>) END)")


def domain_ratios(worded: DataFrame, buckets: int, smoothing: float, trusted: Column
                  ) -> DataFrame:
    """Per bucket the log ratio of its shares among trusted and among all n-grams.

    At most ``buckets`` rows. Counts are taken over the whole table.
    """
    # What is asked of a text stands below the explode, or each n-gram would ask it again; an
    # inner explode would also infer a filter that spells the whole array out once more.
    counts = (
        worded.select(trusted.cast("long").alias("good"),
                      gram_buckets(buckets).alias("grams"))
        .select("good", F.explode_outer("grams").alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    )
    counts = stored(counts, "domain-counts")
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"),
                        F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()

    def share(count: str, total: int) -> Column:
        return (F.col(count) + smoothing) / F.lit(total + smoothing * buckets)
    return counts.select("bucket", F.log(share("good", totals["good"])
                                         / share("raw", totals["raw"])).alias("ratio"))


def domain_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    buckets: int = 1 << 16, smoothing: float = 0.5, threshold: float = -0.1,
                    trusted: Column | None = None) -> DataFrame:
    """Every document's rule figures, its mean log ratio and whether it is kept.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (under 50 words, or over half of them repeated), domain_score and kept. A NULL, empty or
    wordless text has zeros and score 0, and fails the base rules. Repeated rows are judged one
    by one; an empty table gives no rows. ``trusted`` may use the figures and any column of
    ``docs``; without it the texts clear of the base rules by a margin are trusted. ``docs``
    should be read from a table: rows are told apart by their place in it.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    plain = with_words(docs.select(*columns))
    if trusted is None:
        learn, rule = cheap_rules(plain), trusted_texts()
    else:
        learn = cheap_rules(with_words(docs.select("*", F.col(text_col).alias("text"))
                                       if text_col != "text" else docs))
        rule = F.coalesce(trusted, F.lit(False))
    ratios = domain_ratios(learn, buckets, smoothing, rule)
    figures = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = repeat_rule(cheap_rules(plain)).select(
        *figures, F.monotonically_increasing_id().alias("row"),
        gram_buckets(buckets).alias("grams")
    ).select(*figures, "row", F.explode_outer("grams").alias("bucket"))
    # At most ``buckets`` rows of 12 bytes.
    scored = rows.join(F.broadcast(ratios), "bucket", "left").groupBy("row", *figures).agg(
        F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("domain_score"))
    failed = (F.col("n_words") < LEAST_WORDS) \
        | (F.col("n_repeat_words") > F.col("n_words") * F.lit(MOST_REPEATED))
    return scored.withColumn("base_failed", failed).select(
        F.col("id").alias(id_col), *figures[1:], "base_failed", "domain_score",
        (~F.col("base_failed") & (F.col("domain_score") >= threshold)).alias("kept"))
