"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, cut

#: Weights of the sources in order, repeating; share of all words that the mix takes; most copies of a document.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Newton steps at most, and the relative error of a source's words at which they end.
STEPS, CLOSE = 60, 1e-9
#: Documents of one source and size that are ranked in one task, about: more are cut into hash cells, as many for each source and size.
PER_CELL = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) to (source, source_size, target): one row per source.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` of all words by weight; none exceeds ``most`` times its size, and the excess is reshared by
    weight. That fixed point is the water level L with target = min(cap, weight * L), found
    in order of cap / weight. Only this table, one row per source, is ordered as a whole, in one task: sources are
    named origins, some thousands at most, not one for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    level = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = level.rowsBetween(0, Window.unboundedFollowing)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("lvl", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(from_here))
    # the first source, in that order, which the level no longer fills; past it the level stays
    t = t.withColumn("L", F.min(F.when(F.col("lvl") <= F.col("ratio"), F.struct("ratio", "lvl"))).over(everything)["lvl"])
    return t.select("source", "source_size", F.when(F.col("L").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("L"))).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """(source, lam, unit): the dual solution of each source.

    Minimise sum r log r - r over the documents' rates r <= most, subject to sum r * size = target
    for each source. The optimum is r = min(most, exp(lam * z)) with z = size / mean size of the source; lam
    is the root of an increasing function, whose Newton steps are taken over the source's counts by size: one row a
    source holds them in order of size, so sums don't depend on the order of tasks. There are as many as texts have different numbers of words, whatever the
    number of documents. A step that leaves the bracket is halved. All steps are one job; the driver sees
    whether any source has not converged; not to converge in ``steps`` is an error.
    """
    top = F.log(F.lit(float(most)))
    base = (
        cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("total"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.array_sort(F.collect_list(F.when(F.col("size") > 0, F.struct(F.col("size").cast("double").alias("size"), F.col("n").cast("double").alias("n"))))).alias("counts"))
        .join(targets.select(F.col("source").alias("ts"), "target"), F.col("source").eqNullSafe(F.col("ts")))
        .withColumn("unit", F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9)))
        .withColumn("hi", top * F.col("unit") / F.coalesce("least", F.lit(1)))
        .withColumn("lo", F.lit(-1e4) * F.col("unit") / F.coalesce("least", F.lit(1)))
        # nothing to solve: no words, or every document at its most
        .withColumn("done", (F.col("total") == 0) | (F.col("target") >= F.col("total") * F.lit(float(most)) * (1 - 1e-12)))
        .withColumn("lam", F.when(F.col("done"), F.col("hi")).otherwise(F.lit(0.0)))
    )
    goal, unit = F.col("target") / F.col("unit"), F.col("unit")
    made = lambda lo, hi, lam, done: F.struct(lo.alias("lo"), hi.alias("hi"), lam.alias("lam"), done.alias("done"))

    def summed(lam):
        """Words at this lam over the unit, and how they change with it."""
        def add(t, c):
            z = c["size"] / unit
            words = c["n"] * z * F.exp(F.least(lam * z, top))
            return F.struct((t["g"] + words).alias("g"), (t["h"] + F.when(lam * z < top, words * z).otherwise(0.0)).alias("h"))

        return F.aggregate("counts", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add)

    def moved(s, t):
        gap = t["g"] - goal
        near = F.abs(gap) <= F.lit(CLOSE) * F.greatest(goal, F.lit(1e-9))
        lo, hi = F.when(gap < 0, s["lam"]).otherwise(s["lo"]), F.when(gap > 0, s["lam"]).otherwise(s["hi"])
        new = s["lam"] - gap / F.nullif(t["h"], F.lit(0.0))
        return made(lo, hi, F.when(near, s["lam"]).when((new > lo) & (new < hi), new).otherwise((lo + hi) / 2), near)

    # an array of one element gives the sums a name, so that they are taken once a step
    step = lambda s, _: F.when(s["done"], s).otherwise(F.get(F.transform(F.array(summed(s["lam"])), lambda t: moved(s, t)), F.lit(0)))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), made(F.col("lo"), F.col("hi"), F.col("lam"), F.col("done")), step)
    state = cut(base.withColumn("s", solved).select("source", F.col("s.lam").alias("lam"), "unit", F.col("s.done").alias("done")), small=True)
    if state.filter(~F.col("done")).limit(1).count():
        raise RuntimeError(f"rates have not converged after {steps} Newton steps")
    return state.select("source", "lam", "unit")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, carry: bool = False) -> DataFrame:
    """One row per input row: id, size, source_size, target, rate, copies, taken (copies * size).

    ``carry`` keeps the input's own columns instead and adds ``__copies``.

    Rates come from :func:`balance`. They are rounded to whole copies by systematic sampling: in
    each source documents stand in order of size, largest first; the running sum of the rates'
    fractions, from one half, takes a further copy whenever it passes a whole number. The words taken
    then miss the target by half the largest document at most. The running sum is exact across
    tasks: counts by (source, size) and by hash cell are summed as prefixes, and only the
    documents of one cell are ranked together, so that a source with a third of all rows is
    spread over all tasks. Nothing is random: reruns agree.

    A null source is a source of its own. Null and empty texts have size 0 and one copy, which takes
    no words. Rows that repeat an id are separate documents. Rows that agree in id, size and text rank in any order, which
    changes nothing but the other columns that ``carry`` keeps. Null ids rank first in their cell. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.withColumns({"__src": F.col(source_col), "__id": F.col(id_col), "__size": size})
    # rows that repeat an id and differ in their texts are told apart, so that no id fills a cell
    rows = rows.withColumn("__h", F.xxhash64(F.col("__id"), F.col("__size"), F.col(text_col).cast("string")))
    counted = lambda salt: cut(rows.groupBy(F.col("__src").alias("source"), F.col("__size").alias("size"), salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")), small=True)
    whole = counted(F.lit(0).cast("long"))
    salts = int(whole.agg(F.ceil(F.max("n") / PER_CELL)).first()[0] or 1)
    rows = rows.withColumn("__salt", F.pmod(F.col("__h"), F.lit(salts)).cast("long"))
    narrow = rows.select("__src", "__id", "__size", "__h", "__salt") if not carry else rows
    subcells = whole if salts == 1 else counted(F.pmod(F.col("__h"), F.lit(salts)).cast("long"))
    cells = whole.select("source", "size", "n")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, most), small=True)
    lam = balance(cells, targets, most)

    def match(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("source", "__s2")
        return a.join(b, F.col("source").eqNullSafe(F.col("__s2"))).drop("__s2")

    # lam is rounded so that the last bits of a float never decide
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.round("lam", 9) * (F.col("size") / F.col("unit")), F.lit(5.0)))))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    plan = match(match(cells, lam), targets).withColumn("rate", rate).withColumn("frac", F.col("rate") - F.floor("rate")).withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("frac")).over(down), F.lit(0.0))).select(F.col("source").alias("ps"), F.col("size").alias("pz"), "source_size", "target", "rate", "frac", "start")
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = subcells.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = cut(ahead.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))).select(F.col("source").alias("__cs"), F.col("size").alias("__cz"), F.col("salt").alias("__ct"), *[F.col(c).alias(f"__{c}") for c in ("ahead", "source_size", "target", "rate", "frac", "start")]), small=True)
    ranked = narrow.withColumn("__rank", F.row_number().over(Window.partitionBy("__src", "__size", "__salt").orderBy("__h", "__id")))
    out = ranked.join(starts, F.col("__src").eqNullSafe(F.col("__cs")) & (F.col("__size") == F.col("__cz")) & (F.col("__salt") == F.col("__ct")))
    place = F.col("__ahead") + F.col("__rank")
    step = lambda k: F.floor(F.col("__start") + k * F.col("__frac") + F.lit(0.5))
    copies = (F.floor("__rate") + step(place) - step(place - 1)).cast("long")
    if carry:
        return out.select(*df.columns, copies.alias("__copies"))
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (copies * F.col("__size")).alias("taken"), F.col("__rate").alias("rate"), copies.alias("copies"))
