"""Interval joins within an episode: equi-joins on (episode, time bucket), then the exact test.

A bucket key keeps the join from comparing all intervals of an episode; an interval that spans
several buckets stands in each, and a pair is taken in the first bucket that both touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import islands


def bucketed(df: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(lo) / width), F.floor(F.greatest(F.col(hi), F.col(lo)) / width)
    return df.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int, touching: bool = False, how: str = "inner") -> DataFrame:
    """Rows (l_*, r_*) whose [start, end] of one ``ep`` overlap; columns start_us, end_us."""
    l = bucketed(left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)), "l_start_us", "l_end_us", width)
    r = bucketed(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), "r_start_us", "r_end_us", width)
    l, r = l.withColumnRenamed("__first", "__lf"), r.withColumnRenamed("__first", "__rf").withColumnRenamed("__bucket", "__rb")
    less = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
    on = (F.col("l_ep") == F.col("r_ep")) & (F.col("__bucket") == F.col("__rb")) & (F.col("__bucket") == F.greatest("__lf", "__rf"))
    on = on & less(F.col("r_start_us"), F.col("l_end_us")) & less(F.col("l_start_us"), F.col("r_end_us"))
    return l.join(r, on, how).drop("__bucket", "__rb", "__lf", "__rf")


def region_coverage(cues: DataFrame, regions: DataFrame, key: str, width: int) -> DataFrame:
    """Time of each cue inside regions, overlapping regions each counting."""
    shared = F.least("l_end_us", "r_end_us") - F.greatest("l_start_us", "r_start_us")
    inside = overlap_join(cues, regions, width).groupBy("l_ep", f"l_{key}").agg(F.sum(shared).alias("covered_us"), F.max("r_end_us").alias("last_us"))
    return cues.join(inside.select(F.col("l_ep").alias("ep"), F.col(f"l_{key}").alias(key), "covered_us", "last_us"), ["ep", key], "left").withColumn("covered_us", F.coalesce("covered_us", F.lit(0)).cast("long"))


def trailing_silence(cues: DataFrame, regions: DataFrame, key: str, width: int, least_us: int) -> DataFrame:
    """Cues that go on for longer than ``least_us`` after the last speech in them."""
    c = region_coverage(cues, regions, key, width).where("last_us is not null")
    silent = F.col("end_us") - F.least("end_us", "last_us")
    return c.withColumn("silence_us", silent).where(F.col("silence_us") > least_us)


def merge_intervals(df: DataFrame, part: tuple[str, ...] = ("ep",)) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    past = Window.partitionBy(*part).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("start_us") > F.max("end_us").over(past)
    joined = islands(df, new, ["start_us", "end_us"], "island", part)
    return joined.groupBy(*part, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


def turn_overlaps(turns: DataFrame, width: int) -> DataFrame:
    """Times at which two speakers speak, merged."""
    t = turns.select("ep", "start_us", "end_us", "speaker")
    both = overlap_join(t, t, width).where("l_speaker < r_speaker")
    cut = both.select(F.col("l_ep").alias("ep"), F.greatest("l_start_us", "r_start_us").alias("start_us"), F.least("l_end_us", "r_end_us").alias("end_us"))
    return merge_intervals(cut)


def containing_region(points: DataFrame, regions: DataFrame, at: str, key: str, width: int) -> DataFrame:
    """The earliest region that contains the point, else the earliest that the row overlaps."""
    pairs = overlap_join(points, regions, width, touching=True)
    holds = (F.col("r_start_us") <= F.col(f"l_{at}")) & (F.col(f"l_{at}") <= F.col("r_end_us"))
    region = F.struct(F.col("r_start_us").alias("start_us"), F.col("r_end_us").alias("end_us"))
    strict = (F.col("r_start_us") < F.col("l_end_us")) & (F.col("l_start_us") < F.col("r_end_us"))
    best = pairs.groupBy("l_ep", f"l_{key}").agg(F.min(F.when(holds, region)).alias("inside"), F.min(F.when(strict, region)).alias("touched"))
    found = best.select(F.col("l_ep").alias("ep"), F.col(f"l_{key}").alias(key), F.coalesce("inside", "touched").alias("region"))
    return points.join(found, ["ep", key], "left").withColumn("region_start", F.col("region.start_us")).withColumn("region_end", F.col("region.end_us")).drop("region")


def nearest(probes: DataFrame, points: DataFrame) -> DataFrame:
    """For each probe (ep, probe_id, t) the nearest point (ep, point_id, t); earlier among equals.

    Both sides are merged in order; the last point before and the first after are the candidates.
    """
    both = probes.select("ep", "t", "probe_id", F.lit(None).cast("long").alias("point_id")).unionByName(points.select("ep", "t", F.lit(None).cast("long").alias("probe_id"), "point_id"))
    point = F.when(F.col("point_id").isNotNull(), F.struct("t", "point_id"))
    order = Window.partitionBy("ep").orderBy("t", F.col("point_id").asc_nulls_last())
    back = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # among points at one time the first by id is wanted on either side
    d = both.withColumn("low", back).withColumn("high", F.first(point, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    d = d.where("probe_id is not null")
    low, high = F.col("t") - F.col("low.t"), F.col("high.t") - F.col("t")
    take_low = F.col("high").isNull() | (F.col("low").isNotNull() & (low <= high))
    return d.select("ep", "probe_id", F.when(take_low, F.col("low.point_id")).otherwise(F.col("high.point_id")).alias("point_id"), F.when(take_low, low).otherwise(high).alias("distance"))


def speech_envelope(words: DataFrame, regions: DataFrame, width: int, gap_us: int, over_us: int, long_us: int) -> DataFrame:
    """Words that last over ``long_us`` or pass the end of speech by over ``over_us`` are cut.

    Speech is the first region that holds the word's start and those after it, each up to ``gap_us``
    after all before, that begin by the word's end. Words outside all regions are held to ``long_us`` alone.
    """
    order = Window.partitionBy("ep").orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    chained = islands(regions.select("ep", "start_us", "end_us"), F.col("start_us") - F.max("end_us").over(order) > gap_us, ["start_us", "end_us"], "chain")
    pairs = overlap_join(words.select("ep", "word_idx", "start_us", "end_us"), chained, width, touching=True)
    holds = (F.col("r_start_us") <= F.col("l_start_us")) & (F.col("l_start_us") <= F.col("r_end_us"))
    key = ["l_ep", "l_word_idx", "r_chain"]
    chains = pairs.groupBy(*key).agg(F.min(F.when(holds, F.struct("r_start_us", "r_end_us"))).alias("holder"), F.max("r_end_us").alias("speech_end"))
    ends = chains.where("holder is not null").groupBy(F.col("l_ep").alias("ep"), F.col("l_word_idx").alias("word_idx")).agg(F.min_by("speech_end", "holder").alias("speech_end"))
    d = words.join(ends, ["ep", "word_idx"], "left")
    too_long = F.col("end_us") - F.col("start_us") > long_us
    over = F.coalesce(F.col("end_us") - F.col("speech_end") > over_us, F.lit(False))
    end = F.least(F.col("end_us"), F.when(too_long, F.col("start_us") + long_us), F.when(over, F.col("speech_end")))
    return d.withColumn("new_end", F.greatest("start_us", end)).withColumn("clamped", too_long | over).drop("speech_end")
