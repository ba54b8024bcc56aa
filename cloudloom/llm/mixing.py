"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over training time 0..1, piecewise linear between knots.
Its integral, scaled to the source's token target, is the source's cumulative token demand.  The
source's documents stand on a token axis in a hashed order; inverting the demand at the place where a
document begins gives the training position at which it is read.  Sorting all
documents by position interleaves the sources as the schedules ask.

Nothing is gathered in one task: the place of a document on its source's axis is a two-level prefix sum
over (source, hash slot), so a source with a third of all rows is spread over ``slots`` groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm._graph import shared

#: Words are runs of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source name, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: Schedules (time, relative weight) by rank of the source name, repeating as CYCLE does: the heaviest sources fade, the middle ones peak halfway, the lightest grow.
CURRICULUM = (((0.0, 1.0), (0.6, 0.8), (1.0, 0.4)), ((0.0, 0.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.7, 0.75), (1.0, 2.0)))
#: Hash slots of a source. At 10 ** 10 documents of one source a slot has 2.4 million rows.
SLOTS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, cycle: Sequence[float] = CYCLE, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (src, size): rank, weight, source_size and target.

    Sources ranked by code point (null last) weigh ``cycle``, repeating.  They share ``budget`` times all
    words by weight; no target exceeds ``most`` times its source's size, and what is cut off is shared again by weight.
    With the sources in the order of most * size / weight, those that are cut off come first, so the level
    at which the rest share is found with two running sums.  The table has one row per source, as the mix's configuration has.
    """
    by_source = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = ranked.withColumn("weight", weights[(F.col("rank") % len(cycle)).cast("int")]).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = budget * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min_by("level", F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(every)
    return leveled.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), "cap")).select("src", "rank", "weight", "source_size", "target")


def _area(at: int, knots: Sequence[tuple[float, float]]) -> float:
    (t0, w0), (t1, w1) = knots[at], knots[at + 1]
    return (t1 - t0) * (w0 + w1) / 2


def position(offset: Column, target: Column, knots: Sequence[tuple[float, float]] = ((0.0, 1.0), (1.0, 1.0))) -> Column:
    """Training time at which a source's cumulative demand reaches ``offset`` tokens.

    knots: (time, relative weight), linear between them; times rise from 0 to 1.  The demand is quadratic between two knots;
    the root is taken in the form that is stable for a constant weight too.
    """
    areas = [_area(i, knots) for i in range(len(knots) - 1)]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    share = offset / target * whole
    out, done = F.lit(float(knots[-1][0])), whole
    for i in reversed(range(len(areas))):
        done -= areas[i]
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        if areas[i] <= 0:
            continue
        rest = share - done
        slope = (w1 - w0) / (t1 - t0)
        root = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(rest < areas[i], t0 + F.when(rest <= 0, F.lit(0.0)).otherwise(root)).otherwise(out)
    return F.when(target > 0, out)


def mix_sources(
    docs: DataFrame,
    *,
    keep: list[str] | None = None,
    curriculum: Sequence[Sequence[tuple[float, float]]] = (((0.0, 1.0), (1.0, 1.0)),),
    schedules: dict[str | None, Sequence[tuple[float, float]]] | None = None,
    cycle: Sequence[float] = CYCLE,
    budget: float = 1.5,
    most: float = 2.0,
    slots: int = SLOTS,
) -> DataFrame:
    """The rows of ``docs`` in training order, with what the mix takes of each.

    docs needs doc_id, text and source; its columns ``keep`` (all by default) are in the struct ``row``.  Added: size (words),
    source_size, target (words the mix asks of the source), taken (words it takes of the row, repeats counted),
    copies (times the row is begun), position (training time of its first reading; null if never read),
    positions (training times of all its readings, in order).

    The source is read in rounds over its hashed order until its target is reached; the document in which
    it is reached is read up to there, so a source's taken words are its target rounded down.
    curriculum: weight over training time by rank of the source, repeating; constant by default.  schedules: the same by source, for those given.
    Their integrals shape the order, not the target.

    Null text counts no words; null source is a source of its own, weighed last.  Rows that repeat are rows of their own; ties
    in the hashed order are broken by doc_id and size and rows that tie there too are alike.  An empty table gives an empty
    table.  A source without words has target 0.
    """
    source = F.col("source").cast("string")
    # A name that is never null, so that the join and the windows below share one partitioning.
    name = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("doc_id").alias("id"), source.alias("src"), name.alias("name"), n_words(F.col("text")).alias("size"))
    if keep is not None:  # narrow rows, whose words are counted once
        rows = shared(rows)
    spread = rows.withColumn("draw", F.xxhash64("id")).withColumn("slot", F.pmod("draw", F.lit(slots)))
    # Source and slot totals: partial sums in the map tasks, a row for each source and slot after it.
    slot_sizes = shared(spread.groupBy("src", "name", "slot").agg(F.sum("size").alias("size")))
    targets = source_targets(slot_sizes.select("src", "size"), cycle=cycle, budget=budget, most=most)
    begin = F.coalesce(F.sum("size").over(Window.partitionBy("name").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slot_begin = slot_sizes.select("src", "name", "slot", begin.alias("slot_begin"))
    plan = slot_begin.join(targets, slot_begin["src"].eqNullSafe(targets["src"])).drop("src")
    keyed = spread.join(plan, ["name", "slot"])
    within = Window.partitionBy("name", "slot").orderBy("draw", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("offset", F.col("slot_begin") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rounds = [F.greatest(F.lit(0.0), F.least(F.col("size"), F.floor("target") - F.col("offset") - r * F.col("source_size"))) for r in range(int(-(-most // 1)))]
    taken = sum(rounds[1:], rounds[0]).cast("long")
    copies = sum([(x > 0).cast("int") for x in rounds[1:]], (rounds[0] > 0).cast("int"))

    def when(offset: Column) -> Column:
        out = F.coalesce(*[F.when(F.col("rank") % len(curriculum) == i, position(offset, F.col("target"), knots)) for i, knots in enumerate(curriculum)])
        for name, knots in (schedules or {}).items():
            out = F.when(F.col("src").eqNullSafe(F.lit(name)), position(offset, F.col("target"), knots)).otherwise(out)
        return out

    readings = F.array_compact(F.array(*[F.when(x > 0, when(F.col("offset") + r * F.col("source_size"))) for r, x in enumerate(rounds)]))
    mixed = placed.withColumn("taken", taken).withColumn("copies", copies).withColumn("position", F.when(F.col("taken") > 0, when(F.col("offset")))).withColumn("positions", readings)
    mixed = mixed.select("row", "size", "source_size", "target", "taken", "copies", "position", "positions", "draw")
    return mixed.repartitionByRange("position", "draw").sortWithinPartitions("position", "draw").drop("draw")
