"""Splitting texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corvane.functions.text import sentences, strip, tokens, word_count

# Separators from paragraphs to single characters, in order.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", ", ", " ", ""]
# Fixed values end.


def _chunk_id(id_col: str) -> Column:
    return F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))


def with_chunk_columns(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds chunk_id, char_count and word_count."""
    return df.withColumns({"chunk_id": _chunk_id(id_col), "char_count": F.length("chunk").cast("long"), "word_count": word_count(F.col("chunk")).cast("long")})


def fixed_offset(df: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters every size - overlap characters; blank ones are dropped. A last window inside the one before it may appear."""
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size - overlap))
    out = df.filter(F.length(text_col) > 0).select(id_col, text_col, F.posexplode(starts).alias("chunk_index", "start")).withColumn("chunk", F.substring(F.col(text_col), F.col("start") + 1, size)).filter(strip(F.col("chunk")) != "")
    return with_chunk_columns(out.select(id_col, "chunk_index", "start", "chunk"), id_col)


def paragraphs(df: DataFrame, by: str = r"\n\n", shortest: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts between separators, stripped, of at least ``shortest`` characters, with their true offset in the text."""
    parts = F.posexplode(F.split(text_col, by, -1)).alias("part", "raw")
    gap = len(by.encode().decode("unicode_escape"))
    w = Window.partitionBy(id_col).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(id_col, parts).withColumn("at", F.coalesce(F.sum(F.length("raw") + gap).over(w), F.lit(0)))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    rows = rows.withColumn("chunk", strip(F.col("raw"))).filter(F.length("chunk") >= shortest)
    return rows.select(id_col, F.col("part").cast("long").alias("part"), (F.col("at") + lead).cast("long").alias("start"), "chunk")


def sentence_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("position", "sentence"))


# Packing depends on what was packed before, so these are folds; a fold in SQL copies its list at each step. They run on Arrow batches.


def snapped_windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end at a space where they would cut a word; always moves on by one character at least."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text) and not text[end].isspace():
            space = text.rfind(" ", start, end)
            if space > start:
                end = space
        out.append(text[start:end].strip())
        if end >= len(text) and end - overlap <= start:
            break
        start = max(end - overlap, start + 1)
    return [c for c in out if c]


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Greedy packing; a new chunk starts with the last ``overlap`` characters of the one before (none if 0)."""
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if now and len(now) + len(s) > size:
            out.append(now.strip())
            now = f"{now[-overlap:]} {s}" if overlap else s
        else:
            now = f"{now} {s}" if now else s
    return [c for c in [*out, now.strip()] if c]


def split_recursive(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, parts that are too long by the next ones; neighbours are merged up to the size with overlap."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :] or [""]
    pieces = list(text) if sep == "" else text.split(sep)
    if sep:
        pieces[:-1] = [p + sep for p in pieces[:-1]]
    out, now, had = [], [], 0  # had: characters of now
    for p in pieces:
        if len(p) > size:
            if now:
                out.append("".join(now).strip())
                now, had = [], 0
            out += split_recursive(p, size, overlap, rest)
            continue
        if now and had + len(p) > size:
            out.append("".join(now).strip())
            gone = 0
            while gone < len(now) and (had > overlap or had + len(p) > size):
                had -= len(now[gone])
                gone += 1
            now = now[gone:]
        now.append(p)
        had += len(p)
    if now:
        out.append("".join(now).strip())
    return [c for c in out if c]


def merge_short(parts: list[str], shortest: int = 100) -> list[str]:
    """Append to a part until it has ``shortest`` characters."""
    out: list[str] = []
    now = None
    for p in parts:
        if now is None:
            now = p
        elif len(now) < shortest:
            now = f"{now} {p}"
        else:
            out.append(now.strip())
            now = p
    return [c for c in [*out, (now or "").strip()] if c]


def pack_lines(text: str, most: int = 1500) -> list[str]:
    """Sentences of each line, each costing its length and one, up to ``most``; a longer sentence stands alone."""
    parts = [s.strip() for line in text.split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if s.strip()]
    out, now, size = [], [], 0
    for s in parts:
        if now and size + len(s) + 1 > most:
            out.append(" ".join(now))
            now, size = [], 0
        if len(s) + 1 > most:
            out.append(s)
        else:
            now.append(s)
            size += len(s) + 1
    return [*out, " ".join(now)] if now else out


def pack_segments(segments: list, size: int = 500, overlap: int = 50) -> list[dict]:
    """Chunks of timed segments; a chunk begins at its first own segment, its text may begin with the end of the chunk before."""
    out: list[dict] = []
    now = None
    for i, s in enumerate(segments or []):
        text, start, end, sid = s["text"] or "", s["start"], s["end"], i if s["id"] is None else s["id"]
        if now is not None and now["text"] and len(now["text"]) + len(text) > size:
            out.append(now)
            tail = now["text"][-overlap:] if overlap else ""
            now = {"text": f"{tail} {text}" if tail else text, "start_time": start, "end_time": end, "segment_ids": [sid]}
        elif now is None:
            now = {"text": text, "start_time": start, "end_time": end, "segment_ids": [sid]}
        else:
            now["text"] = f"{now['text']} {text}" if now["text"] else text
            now["end_time"] = end
            now["segment_ids"].append(sid)
    out += [now] if now and now["text"] else []
    for c in out:
        c["char_count"], c["text"] = len(c["text"]), c["text"].strip()
        c["duration"] = c["end_time"] - c["start_time"] if c["start_time"] is not None and c["end_time"] is not None else 0.0
        c["word_count"] = len(c["text"].split())
    return out


def _fold(f: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t) if t else [])

    return run


METHODS = {"fixed": snapped_windows, "sentence": pack_sentences, "recursive": split_recursive}


def chunk(df: DataFrame, method: str = "sentence", size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk, chunk_id, char_count, word_count) by one of METHODS, "offset" or "semantic"."""
    if method == "offset":
        return fixed_offset(df, size, overlap, id_col, text_col).drop("start")
    if method == "semantic":
        return semantic(df, size, overlap, id_col, text_col)
    f = METHODS[method]
    return with_chunk_columns(df.select(id_col, F.posexplode(_fold(lambda t: f(t, size, overlap))(F.col(text_col))).alias("chunk_index", "chunk")), id_col)


def merge_and_split(parts: Column, size: int, overlap: int, shortest: int = 100) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: [c for p in merge_short(list(ps), shortest) for c in split_recursive(p, size, overlap)] if ps is not None else [])

    return run(parts)


def break_groups(steps: DataFrame, group: str, order: str, similarity: str = "similarity", quantile: float = 0.05) -> DataFrame:
    """Adds is_break (similarity to the row before is under the group's quantile, interpolated) and block (number of breaks so far)."""
    low = steps.groupBy(group).agg(F.percentile(similarity, F.lit(quantile)).alias("__low"))
    w = Window.partitionBy(group).orderBy(order)
    flagged = steps.join(low, group, "left").withColumn("is_break", F.coalesce(F.col(similarity) < F.col("__low"), F.lit(False)))
    return flagged.withColumn("block", F.sum(F.col("is_break").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__low")


def broken(counts: np.ndarray, similarity: np.ndarray, quantile: float = 0.05) -> np.ndarray:
    """is_break of :func:`break_groups` for rows in order, of which each group has so many; a group's first row has no similarity."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.r_[True, group[1:] != group[:-1]][: len(group)]
    order = np.lexsort((similarity, group))
    order = order[~first[order]]
    n = np.maximum(counts - 1, 0)
    begin, there = np.cumsum(n) - n, np.flatnonzero(n)
    at = (n[there] - 1) * quantile
    a, b = (similarity[order[begin[there] + f(at).astype(np.int64)]] for f in (np.floor, np.ceil))
    low = np.full(len(counts), -np.inf)
    low[there] = np.where(a == b, a, (np.ceil(at) - at) * a + (at - np.floor(at)) * b)
    return ~first & (similarity < low[group])


#: Tokens whose dimension and sign a task keeps.
KNOWN = 1 << 18


def semantic(df: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Break between sentences whose embeddings are least alike (under the text's 5th percentile), merge short parts, split long ones.

    One pass without a shuffle: a text's sentences and their tokens come to a task together. Rows that repeat an id are texts of their own.
    """
    from corvane.functions.vectors import place, similarity_to_previous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, lists, of = part.columns
                of = of.flatten()
                counts, sizes = (pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (lists, of))
                words = of.flatten().dictionary_encode()
                if len(known) > KNOWN:
                    known.clear()
                told = np.array([known[t] if t in known else known.setdefault(t, place(t)) for t in words.dictionary.to_pylist()], np.float64).reshape(-1, 2)
                told = told[words.indices.to_numpy()]
                cut = broken(counts, similarity_to_previous(told[:, 0].astype(np.int64), told[:, 1], sizes))
                sentences_, at, rows, out = lists.flatten().to_pylist(), 0, [], []
                for i, n in enumerate(counts.tolist()):
                    edges = [0, *np.flatnonzero(cut[at : at + n]).tolist(), n] if n else []
                    chunks = [c for p in merge_short([" ".join(sentences_[at + s : at + e]) for s, e in zip(edges, edges[1:])]) for c in split_recursive(p, size, overlap)]
                    rows += [(i, k) for k in range(len(chunks))]
                    out += chunks
                    at += n
                rows = np.array(rows, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[:, 0])), pa.array(rows[:, 1]), pa.array(out, pa.string())], [id_col, "chunk_index", "chunk"])

    s = df.select(id_col, sentences(F.col(text_col)).alias("s")).select(id_col, "s", F.transform("s", tokens).alias("t"))
    return with_chunk_columns(s.mapInArrow(run, StructType([s.schema[id_col], StructField("chunk_index", IntegerType()), StructField("chunk", StringType())])), id_col)


def chunk_transcripts(df: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "audio_file", segments_col: str = "segments") -> DataFrame:
    """Timed chunks of transcripts: segments are array<struct<id, start, end, text>>."""
    kind = "array<struct<text:string,start_time:double,end_time:double,segment_ids:array<int>,char_count:bigint,duration:double,word_count:bigint>>"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "chunks": [pack_segments(list(s) if s is not None else [], size, overlap) for s in pdf[segments_col]]})

    plain = df.select(F.col(id_col), F.transform(segments_col, lambda s: F.struct(s["id"].cast("int").alias("id"), s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), s["text"].alias("text"))).alias(segments_col))
    return plain.mapInPandas(run, f"`{id_col}` {plain.dtypes[0][1]}, chunks {kind}").select(id_col, F.posexplode("chunks").alias("chunk_index", "c")).select(id_col, "chunk_index", "c.*")
