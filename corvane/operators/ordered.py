"""The row before and running sums within a key, without one task holding a key's rows.

Rows are dealt by ranges of (key, order), so a key that holds half of all rows lies in many parts. Within a part Spark's windows do the work; one row for
each part carries what the next part needs across its edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import cut

PART = "__part"


def dealt_in_order(df: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """The rows with the number of their part. Kept in the shared folder: both passes over the parts must see the same ones. Null keys are a key, null orders come first."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first()
    return cut(df.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id()))


def with_previous(dealt: DataFrame, key: str, order: str, columns: list[str], prefix: str = "previous_") -> DataFrame:
    """Adds the columns of the row before, by ``order`` within the key (null for the first), and ``is_first``.

    Orders should tell a key's rows apart; rows of one order stand in any order, but together in a part or over its edge.
    """
    row = F.struct(*[F.col(c).alias(prefix + c) for c in columns])
    here = Window.partitionBy(key, PART).orderBy(F.col(order).asc_nulls_first())
    inside = dealt.withColumn("__before", F.lag(row).over(here)).withColumn("__at", F.row_number().over(here))
    # the last row of each (key, part): a part holds few keys but for small ones, which end inside it; a key's earlier part is the last one before
    last = dealt.groupBy(key, PART).agg(F.max_by(row, F.struct(F.col(order).isNotNull(), F.col(order))).alias("__last"))
    spread = last.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("__wide"))
    edges = last.join(spread, F.col(key).eqNullSafe(F.col("__wide")), "left_semi")  # keys in several parts: at most two for each part
    carried = edges.withColumn("__edge", F.lag("__last").over(Window.partitionBy(key).orderBy(PART))).filter("__edge is not null").select(F.col(key).alias("__k"), F.col(PART).alias("__p"), "__edge")
    out = inside.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("__k")) & (F.col(PART) == F.col("__p")) & (F.col("__at") == 1), "left")
    before = F.coalesce("__before", "__edge")
    return out.select(*dealt.columns, *[before[prefix + c].alias(prefix + c) for c in columns], before.isNull().alias("is_first"))


def with_running_sum(dealt: DataFrame, key: str, order: str, column: str, out_col: str) -> DataFrame:
    """Adds the sum of ``column`` over the key's rows up to this one by ``order``; rows of one order are summed one by one."""
    here = Window.partitionBy(key, PART).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(key, PART).agg(F.sum(column).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    spread = sums.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("__wide"))
    edges = sums.join(spread, F.col(key).eqNullSafe(F.col("__wide")), "left_semi")
    before = edges.withColumn("__base", F.sum("__sum").over(Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("__k"), F.col(PART).alias("__p"), "__base")
    out = dealt.withColumn(out_col, F.sum(column).over(here)).join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__k")) & (F.col(PART) == F.col("__p")), "left")
    return out.select(*dealt.columns, (F.coalesce("__base", F.lit(0)) + F.coalesce(out_col, F.lit(0))).alias(out_col))
