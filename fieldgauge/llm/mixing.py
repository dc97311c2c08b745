"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a word target. Among all document rates that meet it, with no rate above a
ceiling, the one closest in entropy to "every document once" is ``min(ceiling, exp(lambda *
size / scale))`` with one lambda per source. The lambdas solve a convex dual by Newton steps;
each step is one aggregation over a (source, size) histogram, so the documents are read once.

The rates become whole copies by systematic rounding along (source, size): the running sum of
the fractional parts gives a copy wherever it passes a whole number. Running sums are integers
over a range partitioning, so a source with a third of all rows is split like any other, and
reruns agree whatever the partitions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.llm.common import WORD, stored

#: Rates are rounded to this many parts of a copy before they are summed.
PARTS = 1 << 20


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1),
                   share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """One row per source: its size, and its target after water-filling.

    Sources by code point, NULL last, take the weights in turn. They share ``share`` times all
    sizes by weight; a target stops at ``ceiling`` times its source's size and the excess goes
    to the others by weight. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
    )
    # The level if exactly the sources before this one were full.
    level = ((F.lit(float(share)) * F.sum("source_size").over(everything)
              - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    sources = sources.withColumn("level", level)
    right = F.min_by("level", F.when(F.col("level") <= F.col("fills_at"), F.col("fills_at")))
    return sources.withColumn("level", right.over(everything)).select(
        "source", "source_size",
        F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
        .alias("target"))


def _newton_step(state: DataFrame, histogram: DataFrame, ceiling: float, tolerance: float
                 ) -> DataFrame:
    """One safeguarded Newton step of log(words taken) - log(target) for every source.

    Sums are decimal, so they don't depend on the order of rows. Sources go by number: a hash
    table of one whole-number key is small in memory. A source's own figures are equal on all
    its rows, so their maximum carries them through the sums and a step takes one join.
    """
    wide = "decimal(38,6)"
    rate = F.exp(F.col("tilt") * F.col("size"))
    words = F.col("n") * F.col("size") * F.least(F.lit(float(ceiling)), rate)
    slope = F.when(rate < ceiling, F.col("n") * F.col("size") * F.col("size") * rate
                   ).otherwise(0.0)
    sums = histogram.join(state.drop("gap"), "number").groupBy("number").agg(
        F.sum(words.cast(wide)).cast("double").alias("taken"),
        F.sum(slope.cast(wide)).cast("double").alias("slope"),
        *[F.max(c).alias(c) for c in ("target", "high", "low", "full", "tilt")])
    over = F.col("taken") > F.col("target")
    gap = F.log(F.greatest("taken", F.lit(1e-6))) - F.log(F.greatest("target", F.lit(1e-6)))
    newton = F.col("tilt") - gap * F.col("taken") / F.greatest("slope", F.lit(1e-300))
    done = F.col("full") | (F.abs(F.col("new_gap")) <= tolerance)
    return (
        sums.withColumn("new_low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        .withColumn("new_high", F.when(over, F.col("tilt")).otherwise(F.col("high")))
        .withColumn("new_gap", gap).withColumn("step", newton)
        .withColumn("step", F.when((F.col("step") > F.col("new_low"))
                                   & (F.col("step") < F.col("new_high")), F.col("step"))
                    .otherwise((F.col("new_low") + F.col("new_high")) / 2))
        .select("number", "target", F.col("new_high").alias("high"),
                F.col("new_low").alias("low"), "full",
                F.when(done, F.col("tilt")).otherwise(F.col("step")).alias("tilt"),
                F.when(done, F.lit(0.0)).otherwise(F.abs("new_gap")).alias("gap"))
    )


def _tilts(histogram: DataFrame, targets: DataFrame, ceiling: float, tolerance: float,
           rounds: int, steps_per_round: int = 4) -> DataFrame:
    """Per source number the tilt: rate = least(ceiling, exp(tilt * size)).

    Every round plans a few steps together and writes the tilts, one row per source.
    """
    size = F.col("size").cast("double")
    shape = histogram.groupBy("number").agg(
        F.min("size").alias("least_size"),
        (F.sum((F.col("n") * size * size).cast("decimal(38,0)"))
         / F.sum((F.col("n") * size).cast("decimal(38,0)"))).cast("double").alias("usual"))
    # At the upper end of the bracket every document stands at the ceiling.
    top = F.log(F.lit(float(ceiling))) / F.col("least_size")
    share = F.greatest(F.col("target"), F.lit(1e-6)) / F.col("source_size")
    state = stored(
        targets.where("source_size > 0").join(shape, "number")
        .select("number", "target", (top * 1.0000001).alias("high"), (top * -100.0).alias("low"),
                (share >= F.lit(ceiling * (1 - 1e-12))).alias("full"),
                (F.log(share) / F.col("usual")).alias("start"))
        .withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.col("start")))
        .drop("start").withColumn("gap", F.lit(1.0)), "mixing-tilts")
    for _ in range(rounds):
        for _ in range(steps_per_round):
            state = _newton_step(state, histogram, ceiling, tolerance)
        state = stored(state, "mixing-tilts")
        if state.where("gap > 0").isEmpty():
            break
    # Sums have six decimals, so a source of a few words can stay above the tolerance.
    if not state.where("gap > 1e-3").isEmpty():
        raise ValueError(f"tilts not found within {rounds * steps_per_round} steps")
    return state.select("number", "tilt")


def balanced_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
                    share: float = 1.5, ceiling: int = 2, tolerance: float = 1e-9,
                    rounds: int = 15, starts: int = 32) -> DataFrame:
    """Every document with the number of copies that the mix takes.

    Returns id, source, size (words), source_size, target, rate, copies, taken (copies times
    size). A NULL or wordless text has size 0, rate 1 and one copy. A NULL source is a source
    of its own. Repeated rows are documents of their own. An empty table gives no rows.
    ``copies`` is 0 to ``ceiling``. Whole documents are taken, so a source's words differ from
    its target by half its largest document at most; of ``starts`` starting points of the
    rounding, each source takes the one with the least difference.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size")), "mixing-sizes")
    numbered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    targets = stored(source_targets(sized, weights, share, ceiling)
                     .withColumn("number", numbered.cast("long")), "mixing-targets")
    counted = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = stored(
        counted.join(targets.select(F.col("source").alias("of"), "number"),
                     counted["source"].eqNullSafe(F.col("of")))
        .select("number", "size", "n"), "mixing-histogram")
    plan = targets.join(_tilts(histogram, targets, ceiling, tolerance, rounds), "number", "left") \
        .drop("number")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(
        F.least(F.lit(float(ceiling)), F.exp(F.col("tilt") * F.col("size"))))
    rated = (
        sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        .withColumn("rate", rate)
        .withColumn("parts", F.round(F.col("rate") * PARTS).cast("long"))
        .withColumn("part_copy", F.when(F.col("size") > 0, F.col("parts") % PARTS)
                    .otherwise(F.lit(0)).cast("long"))
        .withColumn("draw", F.xxhash64("id"))
    )
    line = ["source", "size", "draw", "id"]
    placed = stored(rated.repartitionByRange(*line)
                    .withColumn("block", F.spark_partition_id()), "mixing-order")
    sums = placed.groupBy("source", "block").agg(F.sum("part_copy").alias("block_sum"))
    along = Window.partitionBy("source").orderBy("block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(
        F.sum("block_sum").over(along), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("block", "source").orderBy("size", "draw", "id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, (placed["block"] == offsets["at"])
                         & placed["source"].eqNullSafe(offsets["of"]))
    summed = stored(
        joined.withColumn("until", F.col("offset") + F.sum("part_copy").over(inside))
        .drop("of", "at", "offset", "block", "draw"), "mixing-sums")

    def extra(start: Column) -> Column:
        """1 where the running sum, begun at ``start``, passes a whole copy."""
        end = F.col("until") + start
        return F.floor(end / PARTS) - F.floor((end - F.col("part_copy")) / PARTS)

    whole = ((F.col("parts") - F.col("part_copy")) / PARTS).cast("long")
    tried = [F.struct(
        F.abs(F.sum((whole + extra(F.lit(k * (PARTS // starts)))) * F.col("size"))
              - F.first("target")).alias("miss"),
        F.lit(k * (PARTS // starts)).alias("start")) for k in range(starts)]
    best = summed.groupBy(F.col("source").alias("of")).agg(
        F.array_min(F.array(*tried))["start"].alias("start"))
    copies = (whole + extra(F.col("start"))).cast("long")
    return (
        summed.join(best, summed["source"].eqNullSafe(best["of"]))
        .withColumn("copies", copies)
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                "source_size", "target", "rate", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )
