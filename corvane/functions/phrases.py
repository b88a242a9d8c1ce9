"""Many phrases at once: an automaton over Arrow batches instead of one search for each phrase."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of all phrases together that are sent to all tasks at most; more are matched in passes.
MOST_BYTES = 32 << 20


class Automaton:
    """Finds all phrases of a list in a text in one walk over it, whatever their number."""

    def __init__(self, phrases: list[tuple]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        ids: dict = {}
        for ident, phrase in phrases:
            ids.setdefault(phrase, []).append(ident)
        for phrase, who in ids.items():
            self.found.add_word(phrase, (len(phrase), who))
        self.some = bool(ids)
        if self.some:
            self.found.make_automaton()

    def places(self, text: str, whole_words: bool) -> Iterator[tuple]:
        """(id, start, end) of each occurrence, overlapping ones too, ends exclusive."""
        for last, (size, who) in self.found.iter(text) if self.some else ():
            start, end = last - size + 1, last + 1
            if whole_words and (start > 0 and _word(text[start - 1]) and _word(text[start]) or end < len(text) and _word(text[end]) and _word(text[last])):
                continue
            for ident in who:
                yield ident, start, end


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def phrase_places(df: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase_id: str = "phrase_id", phrase_col: str = "phrase", lower: bool = True, whole_words: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, phrase_id, start, end): every occurrence of every phrase, by code points, overlapping ones too.

    ``lower`` compares in lower case; ``whole_words`` leaves out occurrences that begin or end inside a word. Null and empty texts and phrases have none; rows that repeat an id have rows of
    their own. Phrases are sent to all tasks, MOST_BYTES at a time: their bytes are summed first, more phrases take more passes over the texts.
    """
    fold = F.lower if lower else (lambda c: c)
    asked = phrases.select(F.col(phrase_id).alias("phrase_id"), fold(F.col(phrase_col)).alias("phrase")).filter("phrase <> ''").distinct()
    size = asked.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    passes = max(1, -(-size // most_bytes))
    plain = df.select(F.col(id_col), fold(F.col(text_col).cast("string")).alias("t")).filter("t <> ''")
    out = None
    for i in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == i)
        rows = [(r.phrase_id, r.phrase) for r in part.toLocalIterator()]
        shared = df.sparkSession.sparkContext.broadcast(rows)
        schema = T.StructType([plain.schema[id_col], T.StructField("phrase_id", phrases.schema[phrase_id].dataType), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            found, types = Automaton(shared.value), [to_arrow_type(f.dataType) for f in schema.fields[1:]]
            for b in batches:
                owner, hits = [], []
                for at, text in enumerate(b.column(1).to_pylist()):
                    for hit in found.places(text, whole_words):
                        owner.append(at)
                        hits.append(hit)
                    if len(hits) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, t) for x, t in zip(zip(*hits), types))], schema.names)
                        owner, hits = [], []
                if hits:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, t) for x, t in zip(zip(*hits), types))], schema.names)

        got = plain.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def phrase_counts(df: DataFrame, phrases: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, phrase_id, n): how often each phrase stands in each document that holds it, overlapping occurrences too."""
    return phrase_places(df, phrases, id_col, **how).groupBy(id_col, "phrase_id").agg(F.count(F.lit(1)).alias("n"))
