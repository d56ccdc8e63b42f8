"""Bounds of an upload looked at in chunks: lines, and the first line that is too long, in bytes.

A chunk's summary needs nothing but the chunk: its line ends, the bytes before the first and after the
last of them, the first long line between, and whether a CR stands at its end or an LF at its start, which
together are one line end. An episode's summaries, folded in order, give the whole content's answer, however
it was cut. A chunk is all that a task reads at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunked(files: DataFrame, size: int = 65_536) -> DataFrame:
    """(ep, nth, chunk) of (ep, content), ``size`` bytes each; empty or null content gives one empty chunk."""
    content = F.coalesce("content", F.lit(b""))
    last = F.greatest(F.ceil(F.length(content) / size) - 1, F.lit(0)).cast("long")
    each = files.select("ep", content.alias("content"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("nth"))
    return each.select("ep", "nth", F.substring("content", (F.col("nth") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def summaries(chunks: DataFrame, most: int) -> DataFrame:
    """(ep, nth, s): what a chunk (ep, nth, chunk) tells of lines of more than ``most`` bytes."""
    text = F.decode("chunk", "ISO-8859-1")
    d = chunks.select("ep", "nth", text.alias("t")).withColumn("lf", F.startswith("t", F.lit("\n")))
    rest = F.when(F.col("lf"), F.substring("t", 2, 2**31 - 1)).otherwise(F.col("t"))
    d = d.withColumn("parts", F.transform(F.split(F.regexp_replace(rest, "\r\n?", "\n"), "\n", -1), lambda x: F.length(x)))
    ends = F.size("parts") - 1
    inner = F.slice("parts", 2, F.greatest(ends - 1, F.lit(0)))
    long = F.nullif(F.array_position(F.transform(inner, lambda n: n > most), F.lit(True)), F.lit(0))
    s = F.struct("lf", F.endswith("t", F.lit("\r")).alias("cr"), (F.col("t") == "").alias("empty"), ends.cast("long").alias("ends"), F.get("parts", 0).cast("long").alias("head"), F.element_at("parts", -1).cast("long").alias("tail"), long.alias("long"))
    return d.select("ep", "nth", s.alias("s"))


def _folded(listed: Column, most: int) -> Column:
    """lines ended, bytes since, whether a CR was last, the first long line's number."""
    none = F.lit(None).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("tail"), F.lit(False).alias("cr"), none.alias("long"))

    def step(a: Column, item: Column) -> Column:
        s = item["s"]
        own = s["lf"] & ~a["cr"]  # an LF that ends a line of its own
        ended = F.when(own & (a["tail"] > most), a["lines"] + 1)
        lines, tail = a["lines"] + own.cast("long"), F.when(own, F.lit(0).cast("long")).otherwise(a["tail"])
        whole = F.when((s["ends"] > 0) & (tail + s["head"] > most), lines + 1)
        return F.struct(
            (lines + s["ends"]).alias("lines"),
            F.when(s["ends"] > 0, s["tail"]).otherwise(tail + s["head"]).alias("tail"),
            F.when(s["empty"], a["cr"]).otherwise(s["cr"]).alias("cr"),
            F.coalesce(a["long"], ended, whole, lines + 1 + s["long"]).alias("long"),
        )

    def finish(a: Column) -> Column:
        return F.struct((a["lines"] + (a["tail"] > 0).cast("long")).alias("lines"), F.coalesce(a["long"], F.when(a["tail"] > most, a["lines"] + 1)).alias("long"))

    return F.aggregate(listed, zero, step, finish)


def scan_chunks(chunks: DataFrame, max_lines: int, max_line_bytes: int) -> DataFrame:
    """Ep, lines, problem of (ep, nth, chunk): too many lines, or the first that is too long.

    Lines end with CR, LF or both; a last line without end counts. An upload is bounded by the web's limits,
    so that an episode's summaries, a few numbers a chunk, are one row's list.
    """
    listed = F.array_sort(F.collect_list(F.struct("nth", "s")))
    d = summaries(chunks, max_line_bytes).groupBy("ep").agg(_folded(listed, max_line_bytes).alias("f"))
    problem = F.when(F.col("f.lines") > max_lines, F.format_string("more than %d lines", F.lit(max_lines)))
    problem = problem.when(F.col("f.long").isNotNull(), F.format_string("line %d is longer than %d bytes", "f.long", F.lit(max_line_bytes)))
    return d.select("ep", F.col("f.lines").alias("lines"), problem.alias("problem"))
