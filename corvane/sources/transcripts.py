"""Transcripts: reading nested JSON, writing text and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import mm_ss, srt_time

WORD = "struct<word:string,start:double,end:double,probability:double>"
SCHEMA = f"audio_filename string, full_text string, language string, language_probability double, duration double, segments array<struct<id:int,start:double,end:double,text:string,duration:double,words:array<{WORD}>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def srt(segments: Column) -> Column:
    """Subtitles of a segments column."""
    block = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s["start"]), F.lit(" --> "), srt_time(s["end"]), F.lit("\n"), F.trim(s["text"]), F.lit("\n"))
    return F.array_join(F.transform(segments, block), "\n")


def timed_text(segments: DataFrame, group: str, order: str, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """(group, transcript): lines "[MM:SS - MM:SS] text" in order."""
    line = F.concat(F.lit("["), mm_ss(F.col(start)), F.lit(" - "), mm_ss(F.col(end)), F.lit("] "), F.col(text))
    return segments.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))
