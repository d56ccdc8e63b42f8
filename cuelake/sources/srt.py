"""SRT text in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timing import parse_srt_time, srt_time

# Fixed value: the line between two times; settings after it are allowed.
TIMES = r"^\s*(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})(?:\s.*)?$"


def parse(texts: DataFrame, max_lines: int | None = None, max_cues: int | None = None, max_line_chars: int | None = None) -> DataFrame:
    """Cues of (ep, value) rows: ep, pos, cue_id, start_ms, end_ms, lines, text, problem.

    Blocks stand between blank lines; ends of lines may be CR, LF or both, and a byte order mark
    goes. A block that is no cue has a ``problem`` and null times instead of ending the run.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("value", F.lit("")), "^﻿", ""), "\r\n?", "\n")
    t = texts.select("ep", clean.alias("t"))
    checks = F.lit(None).cast("string")
    if max_lines:
        checks = F.when(F.size(F.split("t", "\n")) > max_lines, "too many lines").otherwise(checks)
    if max_line_chars:
        checks = F.when(F.exists(F.split("t", "\n"), lambda x: F.length(x) > max_line_chars), "a line is too long").otherwise(checks)
    blocks = F.filter(F.split(F.trim(F.col("t"), F.lit("\n \t")), r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.trim(b) != "")
    t = t.withColumn("limit", checks).withColumn("blocks", blocks)
    if max_cues:
        t = t.withColumn("limit", F.coalesce("limit", F.when(F.size("blocks") > max_cues, "too many cues")))
    b = t.select("ep", "limit", F.posexplode_outer(F.when(F.col("limit").isNull(), F.col("blocks"))).alias("pos", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.rtrim(x))
    b = b.withColumn("all", lines).where("block is not null or limit is not null")
    at = F.get("all", 1)
    start, end = parse_srt_time(F.regexp_extract(at, TIMES, 1)), parse_srt_time(F.regexp_extract(at, TIMES, 2))
    problem = (
        F.when(F.col("limit").isNotNull(), F.col("limit"))
        .when(F.size("all") < 3, F.format_string("block %d is incomplete", F.col("pos") + 1))
        .when(F.trim(F.get("all", 0)).try_cast("int").isNull(), F.format_string("block %d has no number", F.col("pos") + 1))
        .when(start.isNull() | end.isNull(), F.format_string("block %d has no times", F.col("pos") + 1))
    )
    text_lines = F.slice("all", 3, F.greatest(F.size("all") - 2, F.lit(1)))
    return b.select("ep", F.col("pos").cast("long").alias("pos"), F.trim(F.get("all", 0)).try_cast("int").alias("cue_id"), start.alias("start_ms"), end.alias("end_ms"), text_lines.alias("lines"), F.array_join(text_lines, "\n").alias("text"), problem.alias("problem"))


def read_srt(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """Every file of a folder or pattern is an episode, named by its stem."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return parse(files.select(F.regexp_replace("f", r"\.[^.]*$", "").alias("ep"), "value"), **limits)


def block(n: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text)


def render(cues: DataFrame) -> DataFrame:
    """K1: an episode's cues in order of time, renumbered from 1, as one SRT text."""
    n = F.row_number().over(Window.partitionBy("ep").orderBy("start_ms", "end_ms", "cue_id"))
    blocks = cues.withColumn("n", n).select("ep", "n", block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("b"))
    listed = F.array_sort(F.collect_list(F.struct("n", "b")))
    return blocks.groupBy("ep").agg(F.count("*").alias("cues"), F.concat(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("srt"))


def write_srt(cues: DataFrame, path: str) -> None:
    """K1: a folder an episode (``ep=...``) with its SRT text; a cue without text is refused."""
    blank = F.raise_error(F.concat(F.lit("a cue without text: "), F.col("cue_id").cast("string")))
    checked = cues.withColumn("text", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", blank).otherwise(F.col("text")))
    render(checked).select("ep", F.regexp_replace("srt", "\n$", "").alias("srt")).write.partitionBy("ep").text(path)
