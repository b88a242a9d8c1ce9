"""Overlapping boxes by a hierarchy of grids: an equi-join on cells instead of comparing all boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells have a side of 2 to the level of their boxes; boxes smaller than the lowest level's cells use these.
LOWEST = -30
CORNERS = ("x0", "y0", "x1", "y1")


def level(w: Column, h: Column) -> Column:
    """The level whose cells are at least as large as the box, and less than twice as large."""
    return F.greatest(F.ceil(F.log2(F.greatest(w, h))), F.lit(LOWEST)).cast("int")


def _cells(lo: Column, hi: Column, side: Column) -> Column:
    """The one or two cells of its level that a side of a box touches."""
    first, last = F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long")
    return F.sequence(first, last)


def _boxes(df: DataFrame, id_col: str, page: str | None, side: str) -> DataFrame:
    """(page, id, row, corners, level) of the boxes with a positive area and finite corners."""
    c = [F.col(x).cast("double").alias(x) for x in CORNERS]
    out = df.select(*([F.col(page).alias("page")] if page else [F.lit(0).alias("page")]), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), *c)
    finite = " and ".join(f"abs({x}) < 1e300" for x in CORNERS)
    out = out.filter(f"x1 > x0 and y1 > y0 and {finite} and page is not null").withColumn("level", level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return out.select(*[F.col(x).alias(f"{side}_{x}") for x in out.columns])


def _dealt(df: DataFrame, side: str, at: Column) -> DataFrame:
    """A row for each cell of level ``at`` that a box touches: four at most, as cells are no smaller than it."""
    size = F.pow(F.lit(2.0), F.col(f"{side}_at"))
    out = df.withColumn(f"{side}_at", at)
    out = out.withColumn(f"{side}_cx", F.explode(_cells(F.col(f"{side}_x0"), F.col(f"{side}_x1"), size)))
    return out.withColumn(f"{side}_cy", F.explode(_cells(F.col(f"{side}_y0"), F.col(f"{side}_y1"), size)))


def overlapping(a: DataFrame, b: DataFrame | None = None, id_col: str = "id", page: str | None = None) -> DataFrame:
    """(page, id_a, id_b, area, share): pairs of boxes (x0, y0, x1, y1) that share a positive area; share is of the area of the first box.

    Without ``b`` each pair of rows of ``a`` once, the smaller id first (rows that repeat an id are boxes of their own). Boxes meet within a ``page``, if one is named. Boxes with nulls, without area or
    with corners that aren't finite meet none. The larger box of a pair is dealt to the cells of its own level, the smaller one to cells of that size: at most four each, however
    sizes differ, and a pair that meets in several cells is reported in the one that holds the corner of what it shares. Boxes in one such cell mostly overlap, so the work grows
    with the boxes and the result. Large cells are left to the skew handling of the join.
    """
    same = b is None
    one, two = _boxes(a, id_col, page, "l"), _boxes(a if same else b, id_col, page, "s")
    levels = sorted({r[0] for r in one.select("l_level").union(two.select("s_level")).distinct().collect()})  # a few dozen numbers at most
    if not levels:
        levels = [0]
    every = F.array(*[F.lit(x) for x in levels])

    def met(large: DataFrame, small: DataFrame, strictly: bool) -> DataFrame:
        """Pairs whose first box has the larger level (or the same, unless ``strictly``)."""
        own = _dealt(large, "l", F.col("l_level"))
        up = F.explode(F.filter(every, lambda x: (x > F.col("s_level")) if strictly else (x >= F.col("s_level"))))
        probe = _dealt(small, "s", up)
        x0, y0 = F.greatest("l_x0", "s_x0"), F.greatest("l_y0", "s_y0")
        x1, y1 = F.least("l_x1", "s_x1"), F.least("l_y1", "s_y1")
        size = F.pow(F.lit(2.0), F.col("l_at"))
        joined = own.join(probe, (F.col("l_page") == F.col("s_page")) & (F.col("l_at") == F.col("s_at")) & (F.col("l_cx") == F.col("s_cx")) & (F.col("l_cy") == F.col("s_cy")))
        hit = joined.filter((x0 < x1) & (y0 < y1) & (F.floor(x0 / size) == F.col("l_cx")) & (F.floor(y0 / size) == F.col("l_cy")))
        return hit.withColumn("area", (x1 - x0) * (y1 - y0))

    area_of = lambda side: (F.col(f"{side}_x1") - F.col(f"{side}_x0")) * (F.col(f"{side}_y1") - F.col(f"{side}_y0"))
    if same:
        # of boxes of one level each pair stands twice, of others once: the smaller box has the lower level
        pairs = met(one, two, False).filter((F.col("l_level") > F.col("s_level")) | (F.col("l_row") < F.col("s_row")))
        swap = (F.col("l_id") > F.col("s_id")) | (F.col("l_id").isNotNull() & F.col("s_id").isNull())
        pick = lambda x, y: F.when(swap, y).otherwise(x)
        return pairs.select(F.col("l_page").alias("page"), pick(F.col("l_id"), F.col("s_id")).alias("id_a"), pick(F.col("s_id"), F.col("l_id")).alias("id_b"), "area", (F.col("area") / pick(area_of("l"), area_of("s"))).alias("share"))
    down = met(one, two, False).select(F.col("l_page").alias("page"), F.col("l_id").alias("id_a"), F.col("s_id").alias("id_b"), "area", (F.col("area") / area_of("l")).alias("share"))
    flip = lambda df, was, now: df.toDF(*[c.replace(f"{was}_", f"{now}_", 1) for c in df.columns])
    rest = met(flip(two, "s", "l"), flip(one, "l", "s"), True).select(F.col("l_page").alias("page"), F.col("s_id").alias("id_a"), F.col("l_id").alias("id_b"), "area", (F.col("area") / area_of("s")).alias("share"))
    return down.unionByName(rest)
