"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source gets a target of words. Document rates ``r = min(max_copies, exp(lambda * size / mean size))`` are the
maximum-entropy rates (relative to one copy each, boxed at ``max_copies``) under one constraint per source: its rated
words meet its target. The dual in ``lambda`` is convex and separates by source; it is solved for all sources at once
by safeguarded Newton steps, each an aggregation over the distinct (source, size) counts, a sufficient statistic much
smaller than the documents. Rates become copies by systematic rounding along (size class, salt, size), so that the
number of copies never drifts by more than one anywhere along that order; a last step moves single copies of the
best fitting documents to close what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

_ONE = 1 << 32  # rates as fixed-point numbers: sums do not depend on their order


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Up to this many sources their table is broadcast (some 100 bytes each); beyond, joins on the source go by shuffle.
BROADCAST_SOURCES = 50_000


def by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(per_source) if few else per_source, "key")


def source_targets(counts: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """Per source key: source_size, mean, target. ``counts``: key, size, n (rows of that size).

    Targets share the words of all sources by weight (the weights repeat along the keys in code point order) and stop
    at ``max_copies`` times the source's size; the excess goes to the others. With sources in the order of cap/weight
    those before the first with cap/weight >= level are full, where level = (words left) / (weights left).
    """
    per = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    by_key, everything = Window.orderBy("key"), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_key) - 1) % len(weights)) + 1)
    t = per.select("*", w.alias("w"), (F.col("source_size") * float(max_copies)).alias("cap"), F.sum("source_size").over(everything).cast("double").alias("total"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    t = t.select("*", F.row_number().over(order).alias("rn"), F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"), F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"))
    t = t.withColumn("level", (F.col("total") - (F.col("filled") - F.col("cap"))) / F.col("w_left"))
    t = t.withColumn("stop", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("rn", "level"))).over(everything))
    full = F.col("stop").isNull() | (F.col("rn") < F.col("stop.rn"))
    return t.select(
        "key",
        "source_size",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("stop.level"))).alias("target"),
        F.col("cap"),
    )


def _rate(max_copies: int) -> Column:
    z = F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)
    return F.when(F.col("target") >= F.col("cap"), F.lit(float(max_copies))).otherwise(
        F.least(F.lit(float(max_copies)), F.exp(F.least(F.lit(50.0), F.col("lam") * z)))
    )


def solve_dual(counts: DataFrame, sources: DataFrame, max_copies: int, few: bool, max_steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Newton iterations for every source's multiplier; returns ``sources`` with ``lam``.

    A step outside the bracket known so far, or where the slope vanishes, becomes a bisection. The loop reads one
    number per step on the driver: the largest relative gap.
    """
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    state = cut(
        sources.select(
            "*",
            F.when(ratio > 0, F.greatest(F.lit(-50.0), F.log(ratio))).otherwise(-50.0).alias("lam"),
            F.lit(-1e5).alias("lo"),
            F.lit(1e5).alias("hi"),
        )
    )
    z = F.col("size") / F.col("mean")
    for _ in range(max_steps):
        r = _rate(max_copies)
        words = F.coalesce(F.sum(F.col("n") * F.col("size") * r), F.lit(0.0))
        slope = F.coalesce(F.sum(F.when(r < max_copies, F.col("n") * F.col("size") * z * r)), F.lit(0.0))
        got = (
            by_source(counts, state, few)
            .groupBy("key", "source_size", "mean", "target", "cap", "lam", "lo", "hi")
            .agg(words.alias("words"), slope.alias("slope"))
        )
        done = (F.col("target") >= F.col("cap")) | (F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target"))
        lo = F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("words") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("words") - F.col("target")) / F.col("slope")
        middle = (F.col("lo") + F.col("hi")) / 2
        stepped = got.select("key", "source_size", "mean", "target", "cap", "lam", "slope", "words", lo.alias("lo"), hi.alias("hi"), done.alias("done"))
        new = F.when(F.col("done"), F.col("lam")).when((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        state = cut(stepped.select("key", "source_size", "mean", "target", "cap", new.alias("lam"), "lo", "hi", "done"))
        if not state.filter(~F.col("done") & (F.col("hi") - F.col("lo") > 1e-12)).limit(1).count():
            break
        state = state.drop("done")
    return state.select("key", "source_size", "mean", "target", "cap", F.round("lam", 9).alias("lam"))


def _closest(rows: DataFrame, gaps: DataFrame, used: DataFrame | None, max_copies: int, few: bool) -> DataFrame:
    """Per source the one document whose size, added or taken away once, closes most of its gap."""
    j = by_source(rows, gaps, few)
    if used is not None:
        used = used.select("key", F.col("doc_id").alias("used_id"))
        j = j.join(F.broadcast(used) if few else used, "key", "left").filter(F.col("used_id").isNull() | (F.col("used_id") != F.col("doc_id")))
    step = F.when(F.col("gap") > 0, 1).otherwise(-1)
    can = F.when(F.col("gap") > 0, F.col("copies") < max_copies).otherwise(F.col("copies") > 0)
    left = F.abs(F.col("gap") - step * F.col("size"))
    best = j.filter(can & (F.col("size") > 0) & (left < F.abs(F.col("gap")))).groupBy("key").agg(F.min(F.struct(left.alias("left"), F.col("doc_id").alias("doc_id"), step.alias("step"), F.col("size").alias("size"))).alias("b"))
    return best.select("key", "b.doc_id", "b.step", (F.col("b.step") * F.col("b.size")).alias("moved"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_copies: int = 3,
    rows_per_salt: int = 200_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, rate.

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` (0 for null and empty texts, which take nothing). The null source is a
    source of its own, after the others. ``taken = copies * size`` with copies from 0 to ``max_copies``. Equal tables
    give equal results: rates are fixed-point and ties go by a hash of the id. A null id is kept. Rows that repeat an
    id are rounded one by one. An empty table gives an empty result; other columns are ignored. A size class of a source
    is rounded in at least 64 parts, and one for every ``rows_per_salt`` rows of the table, so no task holds one source.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    base = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), n_words(F.col(text_col)).alias("size")))
    counts = cut(base.groupBy("key", "size").agg(F.count("*").alias("n")))
    salts = max(64, (counts.agg(F.sum("n")).first()[0] or 0) // rows_per_salt)
    sources = cut(source_targets(counts, weights, max_copies))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    solved = solve_dual(counts, sources, max_copies, few)

    rated = by_source(base, solved, few).select(
        "doc_id", "key", "size", "source_size", "target",
        _rate(max_copies).alias("rate"),
        F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 8)).otherwise(-1).alias("class"),
        F.xxhash64("doc_id", "size").alias("h"),
    ).withColumns({"fixed": F.round(F.col("rate") * _ONE).cast("long"), "salt": F.pmod(F.col("h"), F.lit(salts))})
    groups = rated.groupBy("key", "class", "salt").agg(F.sum("fixed").alias("own"))
    before = Window.partitionBy("key").orderBy("class", "salt")
    groups = groups.select("key", "class", "salt", (F.sum("own").over(before) - F.col("own")).alias("offset"))
    along = Window.partitionBy("key", "class", "salt").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = rated.withColumn("cum", F.sum("fixed").over(along)).join(groups, ["key", "class", "salt"])
    upto = F.col("offset") + F.col("cum") + _ONE // 2
    # floor division by a power of two, exact in whole numbers
    copies = F.shiftright(upto, 32) - F.shiftright(upto - F.col("fixed"), 32)
    rows = cut(cum.select("doc_id", "key", "size", "source_size", "target", "rate", F.least(copies, F.lit(max_copies)).cast("long").alias("copies")))

    gaps = rows.groupBy("key", "target").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).select("key", "gap")
    used = None
    for _ in range(2):
        found = cut(_closest(rows, gaps, used, max_copies, few))
        gaps = gaps.join(found, "key", "left").select("key", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap"))
        used = found if used is None else used.unionByName(found)
    moves = used.select("doc_id", "key", "step")
    copies = F.col("copies") + F.coalesce("step", F.lit(0))
    return rows.join(moves, ["doc_id", "key"], "left").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"), "rate")
