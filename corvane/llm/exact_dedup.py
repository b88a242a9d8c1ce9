"""Exact deduplication by 128-bit content hash with a byte comparison inside the hash groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after A-Z are lower-cased (``fold_case``). ``keep`` names
    the stable id that stays in each group, the smallest or the largest.

    Plan: rows carry md5 and sha256 of the text. One aggregation by (md5, sha256, text) counts each
    text; since the text itself is a key, rows whose hashes collide never share a group: this is
    the byte comparison. Map-side aggregation sends each text at most once per task, so a text that
    holds a third of all rows moves no more than any other. Rows are led back to their group
    by its two hashes, without their texts; a hot group is then split by the skew join.

    Null text counts as empty. A null id stays null, is never kept_id unless the whole group has
    no id, and is kept only then. Rows repeating an id with equal text are one document: all carry
    the same mark. An empty table gives an empty result. Other columns are not carried.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = ascii_lower(F.col(text_col)) if fold_case else F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.unhex(F.md5("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("s"), "t")
    groups = rows.groupBy("h", "s", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(F.col("h").alias("gh"), F.col("s").alias("gs"), "keep_id", "group_size")
    return (
        rows.drop("t")
        .join(groups, (F.col("h") == F.col("gh")) & (F.col("s") == F.col("gs")))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))
    )
