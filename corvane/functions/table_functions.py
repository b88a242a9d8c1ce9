"""Splitters as table functions, for SQL and for DataFrames.

    register(spark)
    SELECT doc_id, c.* FROM docs, LATERAL chunk_text(text, 'sentence', 500, 50) AS c
    SELECT * FROM pack_segments(TABLE(segments) PARTITION BY audio_file ORDER BY start, 500, 50)

The columns that come out depend on the arguments: they are told when a query is analysed, from constants.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvane.operators.chunking import METHODS, merge_short, pack_lines

#: Ways of cutting a text: those of chunk(), and sentences of each line up to a size ("lines").
WAYS = {**METHODS, "lines": lambda text, size, overlap: pack_lines(text, size)}


def _constant(argument: AnalyzeArgument | None, name: str, default):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class ChunkText:
    """chunk_text(text, method, size, overlap, shortest): (chunk_index, chunk, char_count, word_count).

    ``method`` is one of WAYS; with "offset", windows of fixed width, there is a ``start``, too. Parts below ``shortest`` characters are joined with
    the next, if it is given. Null and empty texts give no row.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, method: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, shortest: AnalyzeArgument | None = None) -> AnalyzeResult:
        way, width, common = _constant(method, "method", "sentence"), _constant(size, "size", 500), _constant(overlap, "overlap", 50)
        if way not in WAYS and way != "offset":
            raise ValueError(f"method must be one of {', '.join([*WAYS, 'offset'])}")
        if width < 1 or not 0 <= common < width:
            raise ValueError("size must be 1 or more, overlap less than size")
        fields = [T.StructField("chunk_index", T.IntegerType()), *([T.StructField("start", T.IntegerType())] if way == "offset" else []), T.StructField("chunk", T.StringType()), T.StructField("char_count", T.LongType()), T.StructField("word_count", T.LongType())]
        return AnalyzeResult(schema=T.StructType(fields))

    def eval(self, text: str, method: str = "sentence", size: int = 500, overlap: int = 50, shortest: int = 0) -> Iterator[tuple]:
        if not text:
            return
        if method == "offset":
            step = size - overlap
            for i, at in enumerate(range(0, len(text), step)):
                piece = text[at : at + size]
                if piece.strip():
                    yield i, at, piece, len(piece), len(piece.split())
            return
        parts = WAYS[method](text, size, overlap)
        for i, piece in enumerate(merge_short(parts, shortest) if shortest else parts):
            yield i, piece, len(piece), len(piece.split())


class PackSegments:
    """pack_segments(TABLE(t) PARTITION BY .. ORDER BY .., size, overlap): timed segments (text, start, end) packed in their order.

    Rows come one at a time, and only the chunk at hand is held, however many segments a recording has. The columns of the table other than these are those of the
    chunk's first own segment. A chunk's text may begin with the end of the chunk before. Null texts are empty.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        own = {f.name: f for f in table.dataType.fields}
        lacking = [c for c in ("text", "start", "end") if c not in own]
        if lacking:
            raise ValueError(f"the table lacks {', '.join(lacking)}")
        if _constant(size, "size", 500) < 1 or _constant(overlap, "overlap", 50) < 0:
            raise ValueError("size must be 1 or more, overlap 0 or more")
        carried = [f for n, f in own.items() if n not in ("text", "start", "end")]
        added = [("chunk_index", T.IntegerType()), ("text", T.StringType()), ("start_time", T.DoubleType()), ("end_time", T.DoubleType()), ("n_segments", T.LongType()), ("char_count", T.LongType()), ("duration", T.DoubleType()), ("word_count", T.LongType())]
        return AnalyzeResult(schema=T.StructType([*carried, *(T.StructField(n, t) for n, t in added)]))

    def __init__(self):
        self.now, self.count, self.overlap = None, 0, 50

    def made(self) -> tuple:
        carried, text, start, end, n = self.now
        bare = text.strip()
        self.count += 1
        return *carried, self.count - 1, bare, start, end, n, len(text), end - start if start is not None and end is not None else 0.0, len(bare.split())

    def eval(self, row, size: int = 500, overlap: int = 50) -> Iterator[tuple]:
        given = row.asDict()
        text, start, end = given.pop("text") or "", *(None if x is None else float(x) for x in (given.pop("start"), given.pop("end")))
        carried = tuple(given.values())
        if self.now is not None and self.now[1] and len(self.now[1]) + len(text) > size:
            tail = self.now[1][-overlap:] if overlap else ""
            yield self.made()
            self.now = (carried, f"{tail} {text}" if tail else text, start, end, 1)
        elif self.now is None:
            self.now = (carried, text, start, end, 1)
        else:
            first, before, began, _, n = self.now
            self.now = (first, f"{before} {text}" if before else text, began, end, n + 1)

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None and self.now[1]:
            yield self.made()


chunk_text, pack_segments = F.udtf(ChunkText), F.udtf(PackSegments)


def register(spark: SparkSession) -> None:
    """Make chunk_text and pack_segments known to a session's SQL."""
    spark.udtf.register("chunk_text", chunk_text)
    spark.udtf.register("pack_segments", pack_segments)


def chunked(df: DataFrame, method: str = "sentence", size: int = 500, overlap: int = 50, text_col: str = "text") -> DataFrame:
    """Rows with their chunks beside them; rows without chunks go. The text is not carried."""
    out = df.lateralJoin(chunk_text(F.col(text_col).outer(), F.lit(method), F.lit(size), F.lit(overlap)))
    return out.drop(text_col)


def packed(segments: DataFrame, by: list[str], order: list[str], size: int = 500, overlap: int = 50) -> DataFrame:
    """Segments (text, start, end) packed for each key of ``by`` in the order of ``order``."""
    return pack_segments(segments.asTable().partitionBy(*by).orderBy(*order), F.lit(size), F.lit(overlap))
