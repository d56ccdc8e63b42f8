"""Whole runs: cues re-timed from words, and cues made from words alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_width, normalized, signature, tokens
from ..functions.timing import snap_ceil, snap_floor
from ..operators import align, quality_control, recurrences, sequence
from ..operators.apply_decisions import plain_text
from ..operators.finalize import Finish, cues_of, finalize, findings_of, overlap_policy
from ..operators.name_drift import name_drift_findings
from ..sources.kept import kept


def cue_tokens(cues: DataFrame) -> DataFrame:
    """(ep, idx, token, cue_id): an episode's tokens numbered through."""
    t = cues.select("ep", "pos", "cue_id", F.posexplode(tokens(F.col("text"))).alias("i", "token"))
    idx = F.row_number().over(Window.partitionBy("ep").orderBy("pos", "i")) - 1
    return t.select("ep", idx.cast("long").alias("idx"), "token", "cue_id")


def aligner_tokens(cues: DataFrame, *more: str) -> DataFrame:
    """(ep, idx, token, cue_id): the normalized tokens of the cues' plain text in any script, empty ones left out; ``more`` are columns of their cue."""
    t = cues.select("ep", "pos", "cue_id", *more, F.posexplode(signature(plain_text(F.coalesce("text", F.lit(""))))).alias("i", "token"))
    idx = F.row_number().over(Window.partitionBy("ep").orderBy("pos", "i")) - 1
    return t.select("ep", idx.cast("long").alias("idx"), "token", "cue_id", *more)


def matched_words(cues: DataFrame, words: DataFrame) -> DataFrame:
    """(ep, cue_id, word_idx, start_us, end_us) of the words that the alignment gives each cue.

    Cues are split as ``aligner_tokens`` has it, words are normalized whole: a hyphenated word is one token
    on both sides. The cues' and words' times choose between repeated ones.
    """
    said = signature(plain_text(F.coalesce("text", F.lit(""))))
    left = cues.select("ep", F.col("pos").alias("idx"), said.alias("tokens"), "cue_id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    heard = words.select("ep", F.col("word_idx").alias("idx"), normalized(F.col("text")).alias("token"), (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"))
    pairs = align.timed_matches(left, heard).withColumnRenamed("right_idx", "word_idx")
    return pairs.join(sequence.dealt(words.select("ep", "word_idx", "start_us", "end_us")), ["ep", "word_idx"])


def retime(cues: DataFrame, matches: DataFrame, fps: float = 30.0, lead_ms: int = 0, tail_ms: int = 40, gap_us: int = 1_500_000, long_us: int = 2_000_000) -> DataFrame:
    """A1: a cue lasts from the first to the last word of its densest cluster, on frames; ``src_*`` keep what it was."""
    dense = sequence.dense_cluster(matches, gap_us, long_us)
    m = dense.select("ep", "cue_id", (F.col("start_us") / 1000).alias("lo"), (F.col("end_us") / 1000).alias("hi"))
    start = F.greatest(F.lit(0), snap_floor(F.col("lo") - lead_ms, fps))
    d = cues.join(m, ["ep", "cue_id"], "left").withColumn("matched", F.col("lo").isNotNull())
    d = d.withColumn("src_start_ms", F.col("start_ms")).withColumn("src_end_ms", F.col("end_ms"))
    d = d.withColumn("start_ms", F.when(F.col("matched"), start).otherwise(F.col("start_ms")).cast("long"))
    return d.withColumn("end_ms", F.when(F.col("matched"), snap_ceil(F.col("hi") + tail_ms, fps)).otherwise(F.col("end_ms")).cast("long")).drop("lo", "hi")


def sync(cues: DataFrame, words: DataFrame, fps: float = 30.0, min_ms: int = 500) -> DataFrame:
    """Aligns, re-times, lengthens short cues into gaps, places unmatched ones and resolves what overlaps.

    One chain without a join of a step with itself, so the alignment runs once.
    """
    timed = retime(cues, matched_words(cues, words), fps)
    # only matched cues say where the same speaker goes on
    later = Window.partitionBy("ep", F.coalesce("speaker", F.lit("__unknown__"))).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    goes_on = F.first(F.when(F.col("matched"), F.col("start_ms")), ignorenulls=True).over(later)
    least = snap_ceil(F.col("start_ms") + min_ms, fps)
    longer = F.when(F.col("end_ms") >= least, F.col("end_ms")).when(F.col("goes_on").isNull() | (F.col("end_ms") > F.col("goes_on")), least).otherwise(F.least(least, F.greatest("end_ms", "goes_on")))
    # neighbours take what a cue's words say; its lengthened end counts for itself alone
    timed = timed.withColumn("goes_on", goes_on).withColumn("longer", F.when(F.col("matched"), longer))
    placed = sequence.interpolate(timed, F.col("matched"), fps, min_ms)
    placed = placed.select("ep", "pos", "cue_id", F.col("new_start").alias("start_ms"), F.coalesce("longer", "new_end").cast("long").alias("end_ms"), "text", "speaker", "timed")
    return recurrences.settled(placed, fps, min_ms)


def generate(words: DataFrame, gap_us: int = 800_000, span_us: int = 5_000_000, fps: float = 30.0, min_ms: int = 500, lead_ms: int = 0, tail_ms: int = 40) -> DataFrame:
    """Cues from words alone, on frames, none reaching into the next.

    A cue begins ``lead_ms`` before its first word and lasts ``tail_ms`` beyond its last, ``min_ms`` at least.
    """
    made = recurrences.words_to_cues(words, gap_us, span_us)
    start = snap_floor(F.greatest(F.lit(0.0), F.col("start_us") / 1000 - lead_ms), fps)
    c = made.select("ep", "pos", (F.col("pos") + 1).alias("cue_id"), start.alias("start_ms"), "end_us", "text", F.col("speaker").cast("string").alias("speaker"))
    end = F.greatest(snap_ceil(F.col("end_us") / 1000 + tail_ms, fps), snap_ceil(F.col("start_ms") + min_ms, fps), F.col("start_ms") + 1)
    c = c.withColumn("end_ms", end.cast("long")).select("ep", "pos", "cue_id", "start_ms", "end_ms", "text", "speaker")
    return sequence.cap_overlaps(c, fps).withColumn("end_ms", F.col("new_end")).drop("new_end")


def finished(cues: DataFrame, source: DataFrame | None = None, p: Finish = Finish()) -> tuple[DataFrame, DataFrame]:
    """(cues, findings) of a run's end: overlaps are told, then the final pass, then what the cues themselves show.

    With ``source`` also the words that it does not spell so. Findings are (ep, kind, severity, cue_ids,
    message, start_ms, end_ms, old_text, new_text). What comes of either pass is written once.
    """
    told = kept(overlap_policy(cues, p), "told")
    done = kept(finalize(cues_of(told), p), "done")
    out = cues_of(done)
    none = F.lit(None).cast("string")
    row = lambda d: d.select("ep", "kind", "severity", "cue_ids", "message", "start_ms", "end_ms", "old_text", "new_text")
    speed = quality_control.cps_lint(out.where("start_ms is not null and end_ms is not null"), display_width(plain_text(F.col("text")))).where("kind is not null").join(out.select("ep", "cue_id", "start_ms", "end_ms"), ["ep", "cue_id"])
    speed = speed.select("ep", "kind", F.lit("warning").alias("severity"), F.array("cue_id").alias("cue_ids"), F.format_string("Cue is read at %.2f characters a second.", "cps").alias("message"), "start_ms", "end_ms", none.alias("old_text"), none.alias("new_text"))
    findings = row(findings_of(told)).unionByName(row(findings_of(done))).unionByName(speed)
    if source is not None:
        drift = name_drift_findings(source, out).withColumns({"start_ms": F.lit(None).cast("long"), "end_ms": F.lit(None).cast("long")})
        findings = findings.unionByName(row(drift))
    return out, findings


def report(cues: DataFrame, width: Callable[[Column], Column]) -> DataFrame:
    """Findings of the final cues, rolled up by episode."""
    return quality_control.qc_summary(quality_control.style_lint(cues, width))
