"""Energy, speech activity and word streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import islands


def dbfs(mean_square: Column) -> Column:
    """Level below full scale of 16-bit samples; minus infinity for silence."""
    return F.when(mean_square > 0, 20 * F.log10(F.sqrt(mean_square) / 32767.0)).otherwise(F.lit(float("-inf")))


def window_energy(samples: DataFrame, frames: int) -> DataFrame:
    """ep, window, n, mean_square from (ep, sample_idx, value)."""
    return samples.groupBy("ep", F.floor(F.col("sample_idx") / frames).alias("window")).agg(F.count("*").alias("n"), F.avg(F.col("value").cast("double") * F.col("value")).alias("mean_square"))


def energy_regions(energy: DataFrame, loud: Column, least: int = 1) -> DataFrame:
    """Runs of adjacent loud windows, ``least`` or more: first and last window."""
    on = energy.where(loud)
    runs = islands(on, F.col("window") - F.lag("window").over(Window.partitionBy("ep").orderBy("window")) > 1, ["window"], "region")
    return runs.groupBy("ep", "region").agg(F.min("window").alias("first"), F.max("window").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def repair_words(words: DataFrame, rejects: float = 0.05) -> DataFrame:
    """Ep, word_idx, text, start, end of usable words (seconds), in order of time.

    Blank texts and times that are missing, not finite or end before 0 go; starts are 0 at least and
    ends a millisecond after. ``too_many`` tells that an episode lost more than its share.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.coalesce((F.trim("text") != "") & finite("start") & finite("end") & (F.col("end") >= 0), F.lit(False))
    d = words.withColumn("good", good)
    lost = F.sum((~F.col("good")).cast("long")).over(Window.partitionBy("ep"))
    n = F.count("*").over(Window.partitionBy("ep"))
    d = d.withColumn("too_many", lost > F.greatest(F.lit(1), F.ceil(n * rejects))).where("good")
    start = F.greatest(F.col("start"), F.lit(0.0))
    d = d.withColumn("given", F.col("word_idx")).withColumn("start", start).withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("start") + 0.001).otherwise(F.col("end")))
    order = Window.partitionBy("ep").orderBy("start", "given")
    return d.select("ep", (F.row_number().over(order) - 1).cast("long").alias("word_idx"), F.trim("text").alias("text"), "start", "end", "given", "too_many")


def forced_rollup(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Words are dealt to cues in order, each taking its number of tokens (n_tokens)."""
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cues.withColumn("first", before).where("n_tokens > 0")
    each = spans.select("ep", "cue_id", F.explode(F.sequence("first", F.col("first") + F.col("n_tokens") - 1)).alias("word_idx"))
    return each.join(words, ["ep", "word_idx"]).groupBy("ep", "cue_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.round(F.avg("confidence"), 4).alias("score"))
