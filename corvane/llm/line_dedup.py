"""Line deduplication over overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(rk, positions): for each text that holds a later occurrence of a window, the lines to remove.

    Occurrences are ordered by (id, position); the first stays. A later one covers its lines, but
    for those that the first occurrence of that window itself takes up in the same text.
    ``rk`` is md5 of the id and the text, so rows repeating an id with other text stay apart.
    """
    w = int(window)
    hashed = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.transform(_lines(F.col(text_col)), lambda x: F.md5(x)).alias("hs")).filter(F.size("hs") >= w)
    spots = hashed.select("id", "rk", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("hs") - (w - 1)), lambda i: F.unhex(F.md5(F.concat(*[F.element_at("hs", i + k) for k in range(w)]))))).alias("pos", "h"))
    first = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rk", "pos")).alias("f")).filter("n > 1").select(F.col("h").alias("fh"), "f")
    later = spots.join(first, F.col("h") == F.col("fh")).filter(~((F.col("rk") == F.col("f.rk")) & (F.col("pos") == F.col("f.pos"))))
    start = F.when(F.col("rk") == F.col("f.rk"), F.greatest("pos", F.col("f.pos") + w)).otherwise(F.col("pos"))
    covered = later.select("rk", F.explode(F.when(start <= F.col("pos") + (w - 1), F.sequence(start, F.col("pos") + (w - 1)))).alias("line"))
    return covered.groupBy("rk").agg(F.collect_set("line").alias("positions"))


def row_key(id_col: str, text_col: str):
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), F.lit("\n"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """The input with repeated passages of ``window`` lines removed from ``text_col``.

    Windows of consecutive lines are hashed (md5 over the lines' md5); windows found more than
    once anywhere keep their first occurrence in order of (id, position), and lines covered by later ones
    go. Overlapping windows merge, so a repeated passage of any length from three lines goes whole.

    Texts of fewer lines than the window, empty and null texts stay as they are. Null ids order
    last. Rows repeating both id and text count as one text. All other columns pass through;
    ``counts`` names two added columns, which replace columns of these names, or is None.

    Only hashes and positions are shuffled to find the windows; a window that a third of all rows
    hold is counted map-side, and its occurrences meet the single first one in a join that AQE
    splits. A text's positions (at most its number of lines) are gathered, never a window's texts.
    """
    keys = df.withColumn("__rk", row_key(id_col, text_col))
    cuts = repeated_lines(df, id_col, text_col, window).select(F.col("rk").alias("__ck"), F.col("positions").alias("__cut"))
    lines = _lines(F.col(text_col))

    def between(x):
        """The lines between those to be cut, stretch by stretch: the work is that of the lines, not lines times cuts."""
        stretch = lambda i: F.slice(x["lines"], F.get(x["edges"], i) + 2, F.get(x["edges"], i + 1) - F.get(x["edges"], i) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["edges"]) - 2), stretch)), "\n")

    edges = F.concat(F.array(F.lit(-1)), F.array_sort("__cut"), F.array(F.size(lines)))
    kept = F.get(F.transform(F.array(F.struct(lines.alias("lines"), edges.alias("edges"))), between), F.lit(0))  # bound once
    out = keys.join(cuts, F.col("__rk") == F.col("__ck"), "left")
    if counts:
        out = out.withColumns({counts[0]: F.when(F.coalesce(F.col(text_col), F.lit("")) == "", F.lit(0)).otherwise(F.size(lines)).cast("long"), counts[1]: F.coalesce(F.size("__cut"), F.lit(0)).cast("long")})
    return out.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(kept)).drop("__rk", "__ck", "__cut")


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: md5(x)) AS hs FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, len(hs) - 3)) AS pos, hs FROM d WHERE len(hs) >= 3),
s AS (SELECT doc_id, pos, md5(hs[pos + 1] || hs[pos + 2] || hs[pos + 3]) AS h FROM w),
f AS (SELECT h, min((doc_id, pos)) AS f FROM s GROUP BY h HAVING count(*) > 1),
later AS (SELECT s.doc_id, s.pos, CASE WHEN s.doc_id = f.f[1] THEN greatest(s.pos, f.f[2] + 3) ELSE s.pos END AS start
          FROM s JOIN f USING (h) WHERE NOT (s.doc_id = f.f[1] AND s.pos = f.f[2])),
c AS (SELECT doc_id, list_distinct(flatten(list(generate_series(start, pos + 2)))) AS cut FROM later GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(d.hs) END AS BIGINT) AS n_lines, CAST(coalesce(len(c.cut), 0) AS BIGINT) AS n_removed,
  CASE WHEN c.cut IS NULL OR len(c.cut) = 0 THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(c.cut, i - 1)), chr(10)) END AS text
FROM d LEFT JOIN c USING (doc_id)
"""
