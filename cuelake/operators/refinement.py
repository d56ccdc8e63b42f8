"""Cues against words and speech: scores, coverage, boundaries, findings by region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import cps, snap_ceil, snap_floor
from .intervals import overlap_join


def cue_scores(cues: DataFrame, cue_words: DataFrame, words: DataFrame, forced: DataFrame | None, width: Column) -> DataFrame:
    """Ep, cue_id, cps, score, source: a forced score, else the mean confidence of the cue's words, else 0.

    cue_words: (ep, cue_id, word_idx). forced: (ep, cue_id, score, seq), the last one counting, or none.
    """
    heard = cue_words.join(words.select("ep", "word_idx", "confidence"), ["ep", "word_idx"]).groupBy("ep", "cue_id").agg(F.avg("confidence").alias("heard"))
    d = cues.withColumn("cps", cps(width, F.col("end_ms") - F.col("start_ms"))).select("ep", "cue_id", "cps").join(heard, ["ep", "cue_id"], "left")
    if forced is None:
        d = d.withColumn("forced", F.lit(None).cast("double"))
    else:
        d = d.join(forced.groupBy("ep", "cue_id").agg(F.max_by("score", "seq").alias("forced")), ["ep", "cue_id"], "left")
    source = F.when(F.col("forced").isNotNull(), "forced_alignment").when(F.col("heard").isNotNull(), "asr_confidence").otherwise("unscored")
    return d.select("ep", "cue_id", "cps", F.round(F.coalesce("forced", "heard", F.lit(0.0)), 4).alias("score"), source.alias("source"))


def anchor_coverage(ops: DataFrame) -> DataFrame:
    """A3: ep, coverage: matches over left tokens of an edit script."""
    return ops.groupBy("ep").agg(F.count(F.when(F.col("kind") == "match", 1)).alias("n"), F.count("left_idx").alias("tokens")).where("tokens > 0").select("ep", F.round(F.col("n") / F.col("tokens"), 4).alias("coverage"))


def region_cues(cues: DataFrame, regions: DataFrame, width_us: int) -> DataFrame:
    """For each region (ep, region_idx, start_us, end_us) the cues it overlaps, in order; regions without any are left out."""
    timed = cues.select("ep", "pos", "cue_id", (F.col("start_ms") * 1000).alias("start_us"), (F.col("end_ms") * 1000).alias("end_us"))
    pairs = overlap_join(regions.select("ep", "region_idx", "start_us", "end_us"), timed, width_us)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r_pos", "r_cue_id"))), lambda x: x["r_cue_id"])
    return pairs.groupBy(F.col("l_ep").alias("ep"), F.col("l_region_idx").alias("region_idx")).agg(listed.alias("cue_ids"))


@dataclass(frozen=True)
class Refinement:
    """Paddings, the longest extension and the silences that are let be; a word over ``word_ms`` is an outlier. Milliseconds."""

    start_pad: int = 40
    end_pad: int = 40
    extension: int = 300
    leading: int = 150
    trailing: int = 300
    word_ms: int = 2000
    min_ms: int = 500


def _held(points: DataFrame, regions: DataFrame, width_us: int, name: str) -> DataFrame:
    """The first region that holds each point (ep, cue_id, at): ``name`` is its (start, end)."""
    p = points.select("ep", "cue_id", F.col("at").alias("start_us"), F.col("at").alias("end_us"))
    pairs = overlap_join(p, regions.select("ep", "start_us", "end_us"), width_us, touching=True)
    return pairs.groupBy(F.col("l_ep").alias("ep"), F.col("l_cue_id").alias("cue_id")).agg(F.min(F.struct(F.col("r_start_us").alias("s"), F.col("r_end_us").alias("e"))).alias(name))


def _met(spans: DataFrame, regions: DataFrame, width_us: int, first: str, last: str | None = None) -> DataFrame:
    """The first and last region that each span (ep, cue_id, start_us, end_us) overlaps."""
    r = F.struct(F.col("r_start_us").alias("s"), F.col("r_end_us").alias("e"))
    got = overlap_join(spans, regions.select("ep", "start_us", "end_us"), width_us).groupBy(F.col("l_ep").alias("ep"), F.col("l_cue_id").alias("cue_id"))
    return got.agg(F.min(r).alias(first), *([F.max(r).alias(last)] if last else []))


def refine_boundaries(cues: DataFrame, regions: DataFrame, cue_words: DataFrame, words: DataFrame, width_us: int, fps: float = 30.0, p: Refinement = Refinement()) -> DataFrame:
    """Ep, pos, cue_id, new_start, new_end, refined, too_short: cues brought to where speech begins and ends.

    A cue with matched words looks at the regions around its first and last word, another at those it
    overlaps; without any it stays. Late speech moves a start, speech that goes on a little or stops
    early an end. No cue passes the next one's start; ``too_short`` tells that it then lasts under
    ``min_ms``.
    """
    timed = cues.select("ep", "pos", "cue_id", "start_ms", "end_ms", (F.col("start_ms") * 1000).alias("start_us"), (F.col("end_ms") * 1000).alias("end_us"))
    w = cue_words.join(words.select("ep", "word_idx", "start_us", "end_us"), ["ep", "word_idx"])
    word = F.struct("start_us", "end_us")
    ends = w.groupBy("ep", "cue_id").agg(F.min(word).alias("a"), F.max(word).alias("z"))
    odd = F.col("z.end_us") - F.col("z.start_us") > p.word_ms * 1000
    ends = ends.withColumn("odd", odd)
    span = lambda c: ends.select("ep", "cue_id", f"{c}.*")
    probe = ends.select("ep", "cue_id", F.when(F.col("odd"), F.col("z.start_us")).otherwise(F.col("z.end_us")).alias("at"))
    at = lambda c: ends.select("ep", "cue_id", F.col(f"{c}.start_us").alias("at"))
    d = ends
    for found in (_held(at("a"), regions, width_us, "a0"), _met(span("a"), regions, width_us, "a1"), _held(probe, regions, width_us, "z0"), _held(at("z"), regions, width_us, "z1"), _met(span("z"), regions, width_us, "z2")):
        d = d.join(found, ["ep", "cue_id"], "left")
    d = d.select("ep", "cue_id", "z", "odd", F.coalesce("a0", "a1").alias("wa"), F.coalesce("z0", "z1", "z2").alias("wz"))
    d = timed.join(d, ["ep", "cue_id"], "left").join(_met(timed.select("ep", "cue_id", "start_us", "end_us"), regions, width_us, "ca", "cz"), ["ep", "cue_id"], "left")
    by_word = F.col("z").isNotNull()
    d = d.withColumn("first", F.when(by_word, F.col("wa")).otherwise(F.col("ca"))).withColumn("last", F.when(by_word, F.col("wz")).otherwise(F.col("cz")))
    ms = lambda c: F.floor(F.col(c) / 1000).cast("long")
    d = d.withColumn("begins", ms("first.s")).withColumn("stops", ms("last.e"))
    start = F.when(F.col("begins") - F.col("start_ms") <= p.leading, F.col("start_ms")).otherwise(F.greatest(F.lit(0), snap_floor(F.col("begins") - p.start_pad, fps)))
    padded, spoken, end = snap_ceil(F.col("stops") + p.end_pad, fps), snap_ceil(F.col("z.end_us") / 1000 + p.end_pad, fps), F.col("end_ms")
    over = F.col("stops") - end
    plain_end = F.when(((over > p.end_pad) & (over <= p.extension)) | (end - padded > p.trailing), padded).otherwise(end)
    word_end = (
        F.when(F.col("odd"), padded).when(end < spoken, spoken).when((end < padded) & (padded - spoken <= p.trailing), padded)
        .when(end - spoken > p.trailing, F.greatest(spoken, F.least(end, padded))).otherwise(end)
    )
    nxt = F.lead("start_ms").over(Window.partitionBy("ep").orderBy("pos"))
    d = d.withColumn("cap", nxt).withColumn("s", start.cast("long")).withColumn("e", F.when(by_word, word_end).otherwise(plain_end).cast("long"))
    d = d.withColumn("e", F.greatest(F.least("e", F.coalesce("cap", "e")), snap_ceil(F.col("s") + p.min_ms, fps)))
    d = d.withColumn("e", F.when(F.col("e") > F.col("cap"), F.greatest("s", "cap")).otherwise(F.col("e")))
    found = F.col("first").isNotNull() & F.col("last").isNotNull()
    d = d.withColumn("new_start", F.when(found, F.col("s")).otherwise(F.col("start_ms"))).withColumn("new_end", F.when(found, F.col("e")).otherwise(end))
    moved = (F.col("new_start") != F.col("start_ms")) | (F.col("new_end") != end)
    return d.select("ep", "pos", "cue_id", "new_start", "new_end", moved.alias("refined"), (found & (F.col("new_end") - F.col("new_start") < p.min_ms)).alias("too_short"))


def union_flags(*streams: DataFrame) -> DataFrame:
    """Findings of several steps one after the other: ``step`` and then ``nth`` give their order; columns that a step lacks are null."""
    out = None
    for step, flags in enumerate(streams):
        d = flags.withColumn("step", F.lit(step))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
