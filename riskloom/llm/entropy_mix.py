"""Mixing sources to target weights by entropy balancing.

Each document gets the rate min(3, exp(lambda * size / mean size)), the least change of all rates (in relative entropy) under which
its source's words add up to the source's target. The lambdas are the roots of the convex dual, found by safeguarded Newton
steps: each is one distributed aggregation over the table of (source, size) counts, and the steps of all sources run
together. Rates are then rounded to whole copies along the sizes of a source, so that the rounding errors of near sizes cancel.
All sums are of whole numbers, so reruns agree to the last row whatever the order of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE_RUN, shielded, small, text_of, unshielded, words_of, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rates are held in these fractions, exact in sums.
UNIT = 1 << 20
#: Orders of a source's sizes (the first is by size) and places where its running sums may begin; the pair whose words come nearest
#: to the target is taken.
ORDERS, OFFSETS = 8, 32
#: Single copies given or taken at last, for sources of few documents.
FIXES = 2
#: Parts into which equal sizes of one source are dealt, so that no task holds them all.
PARTS = 512


def source_key(source: str) -> Column:
    """A source as a join key that also names null."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``src``, ``source_size``, ``target`` from rows of ``src`` and ``size``.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target stops at ``most`` times the source's size and
    the excess goes to the others by weight: with sources sorted by the level at which they stop, those that stop come first.
    """
    per = sizes.groupBy("src").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy((F.col("src") == "n").cast("int"), "src")
    turn = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    by_level = Window.orderBy(most * F.col("source_size") / F.col("weight"), "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    stops = F.col("level") * F.col("weight") > most * F.col("source_size")
    level = F.min(F.when(~stops, F.struct((most * F.col("source_size") / F.col("weight")).alias("o"), F.col("src"), F.col("level").alias("level")))).over(everything)
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(level["level"], F.lit(0.0)) * F.col("weight"))
    return per.select("src", "source_size", target.alias("target"))


def _rate(lam: Column, size: Column, mean: float, most: int) -> Column:
    """Whole ``UNIT``-ths, up to ``most``."""
    return F.least(F.lit(most * UNIT), F.round(F.exp(F.least(lam * size / mean, F.lit(2.0))) * UNIT)).cast("long")


def solve(histogram: DataFrame, aims: DataFrame, mean: float, most: int = MOST, steps: int = 60) -> DataFrame:
    """``src`` and ``lam``: the dual's root for each source, from its (src, size, n) counts and targets.

    A step that leaves the bracket known to hold the root is replaced by the bracket's middle. Ends when every source's words
    are within a ten-thousandth of its target, or rates can't tell nearer.
    """
    top = math.log(most) * mean + 1
    now = aims.select("src", "target", F.lit(0.0).alias("lam"), F.lit(-40.0 * mean).alias("lo"), F.lit(top).alias("hi"), F.lit(1.0).alias("off"))
    for step in range(steps):
        cells = histogram.join(now, "src")
        rate = _rate(F.col("lam"), F.col("size"), mean, most)
        mass = F.sum((rate * F.col("n") * F.col("size")).cast("decimal(38,0)"))
        # The slope's terms carry size / mean in thousandths, to stay whole.
        slope = F.sum(F.when(rate < most * UNIT, (rate * F.col("n") * F.col("size")).cast("decimal(38,0)") * F.round(F.col("size") * 1000 / mean).cast("long")).otherwise(0))
        sums = cells.groupBy("src", "target", "lam", "lo", "hi").agg((mass.cast("double") / UNIT).alias("mass"), (slope.cast("double") / UNIT / 1000).alias("slope"))
        gap = F.col("mass") - F.col("target")
        sums = sums.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        off = F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(0.0)
        done = off < 1e-4
        moved = F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = written(sums.select("src", "target", moved.alias("lam"), "lo", "hi", off.alias("off")).coalesce(1), "newton")
        if now.filter("off >= 1e-4").isEmpty():
            break
    return now.select("src", "lam")


def _settled(cells: DataFrame, extra: Column, most: int) -> DataFrame:
    """``cells`` with ``fix``: 1 or -1 where the first document of a size takes a copy more or less, else 0.

    A source with few documents may miss its target by part of a large one. ``FIXES`` times, the size that brings the source
    nearest to its target gives or takes one copy.
    """
    whole = F.floor(F.col("rate") / UNIT)
    first = whole + F.floor((F.col("base") + F.col("frac") + F.col("offset")) / UNIT) - F.floor((F.col("base") + F.col("offset")) / UNIT)
    cells = cells.withColumn("first", first).withColumn("words", F.col("size") * (F.col("n") * whole + extra)).withColumn("fix", F.lit(0))
    source = Window.partitionBy("src")
    for _ in range(FIXES):
        cells = cells.withColumn("gap", F.col("target") - F.sum(F.col("words") + F.col("size") * F.col("fix")).over(source))
        step = F.when((F.col("gap") > 0) & (F.col("first") < most), 1).when((F.col("gap") < 0) & (F.col("first") > 0), -1)
        cells = cells.withColumn("step", F.when((F.col("fix") == 0) & (F.col("size") > 0), step))
        left = F.abs(F.col("gap") - F.col("step") * F.col("size"))
        cells = cells.withColumn("left", left).withColumn("place", F.row_number().over(source.orderBy(F.asc_nulls_last("left"), "size")))
        chosen = (F.col("place") == 1) & (F.col("left") < F.abs("gap"))
        cells = cells.withColumn("fix", F.when(chosen, F.col("step")).otherwise(F.col("fix")))
    return cells.drop("first", "words", "gap", "step", "left", "place")


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies`` (0 to ``most``).

    ``size`` names a column of sizes; by default a document's size is its number of words. Null and empty texts have size 0 and
    one copy, of no words. A null source is a source. Equal rows may get different numbers of copies, but always the same
    numbers between them.
    """
    own = F.size(words_of(text_of(text), SPACE_RUN)) if size is None else F.coalesce(F.col(size), F.lit(0))
    order = F.xxhash64(F.col(doc), text_of(text)) if size is None else F.xxhash64(F.col(doc))
    rows = docs.withColumns({"_src": source_key(source), "_size": own.cast("long"), "_order": order})
    rows = rows.withColumn("_part", F.pmod("_order", F.lit(PARTS)).cast("int"))
    thin = rows.select(F.col("_src").alias("src"), F.col("_size").alias("size"), F.col("_part").alias("part"))
    parts = written(thin.groupBy("src", "size", "part").agg(F.count("*").alias("n")), "mix_parts")
    histogram = written(parts.groupBy("src", "size").agg(F.sum("n").alias("n")), "mix_sizes")
    total = histogram.agg(F.sum(F.col("size") * F.col("n")).alias("t"), F.sum("n").alias("n")).first()
    mean = max((total["t"] or 0) / max(total["n"] or 1, 1), 1.0)
    aims = small(written(targets(histogram.select("src", (F.col("size") * F.col("n")).alias("size")), weights, most).coalesce(1), "mix_targets"))
    lams = small(solve(histogram, aims, mean, most))
    # Copies beyond the whole part: along a source's documents, one takes one more each time the running sum of fractions passes a
    # whole number.
    cells = histogram.join(lams, "src").join(aims, "src").withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size"), mean, most)).otherwise(UNIT))
    cells = cells.withColumn("frac", F.col("rate") % UNIT)
    cells = cells.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    shuffled = F.when(F.col("turn") == 0, F.col("size")).otherwise(F.xxhash64("size", "turn"))
    earlier = Window.partitionBy("src", "turn").orderBy(shuffled, "size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum(F.col("frac") * F.col("n")).over(earlier), F.lit(0)))
    cells = written(cells.drop("lam"), "mix_rates")
    tried = cells.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(UNIT - 1).cast("long"), F.lit(UNIT // OFFSETS).cast("long"))))
    extra = F.floor((F.col("base") + F.col("n") * F.col("frac") + F.col("offset")) / UNIT) - F.floor((F.col("base") + F.col("offset")) / UNIT)
    words = F.sum(F.col("size") * (F.col("n") * F.floor(F.col("rate") / UNIT) + extra))
    tried = tried.groupBy("src", "turn", "offset").agg(words.alias("words"), F.first("target").alias("target"))
    best = tried.groupBy("src").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "turn", "offset")).alias("best"))
    cells = cells.join(small(written(best.select("src", "best.turn", "best.offset"), "mix_offsets")), ["src", "turn"])
    cells = _settled(cells, extra, most)
    inner = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("skip", F.coalesce(F.sum("n").over(inner), F.lit(0))).select("src", "size", "part", "skip")
    placed = placed.join(cells.drop("n"), ["src", "size"])
    placed = placed.select(*[F.col(c).alias(f"_{c}") for c in ("src", "size", "part", "skip", "rate", "frac", "base", "offset", "fix", "source_size", "target")])
    rank = F.row_number().over(Window.partitionBy("_src", "_size", "_part").orderBy("_order", doc))
    ranked = rows.withColumn("_rank", rank).join(placed, ["_src", "_size", "_part"])
    upto = F.col("_base") + (F.col("_skip") + F.col("_rank")) * F.col("_frac")
    upto = upto + F.col("_offset")
    more = F.floor(upto / UNIT) - F.floor((upto - F.col("_frac")) / UNIT)
    copies = F.floor(F.col("_rate") / UNIT) + more + F.when(F.col("_skip") + F.col("_rank") == 1, F.col("_fix")).otherwise(0)
    return ranked.select(*docs.columns, "_size", "_source_size", "_target", copies.cast("int").alias("_copies"))


def mixed(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, with its own columns."""
    rows, names = shielded(docs)
    out = mix(rows, names[doc], names[text], names[source]).filter("_copies > 0")
    return unshielded(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)
