"""Predicates, placements and removals around decisions and generated cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repetitive
from ..functions.timing import snap_ceil, snap_floor
from .intervals import overlap_join

# Kinds of findings that the last stage of a run works out anew.
RECOMPUTED = (
    "asr_word_clamped", "cps_cue_merged", "cps_duration_extended", "cue_on_silence", "cue_without_speech_activity", "cue_with_excessive_trailing_silence",
    "adlib_removed_without_speech_activity", "duplicate_cue_merged", "forced_alignment_refined", "impossible_cps_fast", "impossible_cps_slow",
    "output_overlap_resolved", "overlap_detected", "speaker_transition_gap_inserted", "timing_refined", "vad_provider_fallback",
)


def without_stale(flags: DataFrame, kinds: tuple[str, ...] = RECOMPUTED) -> DataFrame:
    """Findings that a resumed run keeps; one without kind is kept."""
    return flags.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))


def known_different(left: Column, right: Column, left_character: Column | None = None, right_character: Column | None = None) -> Column:
    """Both speakers are known and differ, or both characters are, where these are given."""
    differ = lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    speakers = differ(left, right)
    return speakers if left_character is None or right_character is None else speakers | differ(left_character, right_character)


def anchor_speaker(ids: Column, anchor: Column) -> Column:
    """``confirmed``, ``compatible`` or ``other``."""
    return F.when(F.size(ids) == 0, "compatible").when(anchor.isNull(), "compatible").when((F.size(ids) == 1) & (F.get(ids, 0) == anchor), "confirmed").when(F.array_contains(ids, anchor), "compatible").otherwise("other")


def ordered_intervals(words: DataFrame) -> DataFrame:
    """Whether an episode's words are usable: starts at 0 or later, never falling, ends after them."""
    last = F.lag("start_us").over(Window.partitionBy("ep").orderBy("word_idx"))
    good = (F.col("start_us") >= 0) & (F.col("end_us") >= F.col("start_us")) & F.coalesce(F.col("start_us") >= last, F.lit(True))
    return words.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("ep").agg(F.bool_and("good").alias("usable"))


def snippet_windows(spans: DataFrame, pad: int, most: int) -> DataFrame:
    """Spans with padding, at 0 or later; longer ones are cut around their middle."""
    lo, hi = F.greatest(F.lit(0), F.col("start_us") - pad), F.col("end_us") + pad
    d = spans.withColumn("lo", lo).withColumn("hi", hi)
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    long = F.col("hi") - F.col("lo") > most
    start = F.when(long, F.greatest(F.lit(0), middle - most // 2)).otherwise(F.col("lo"))
    return d.withColumn("snip_start", start.cast("long")).withColumn("snip_end", F.when(long, F.col("snip_start") + most).otherwise(F.col("hi")).cast("long")).drop("lo", "hi")


def region_ends(cues: DataFrame, regions: DataFrame, key: str, width: int) -> DataFrame:
    """The first and last region that each cue overlaps."""
    r = F.struct(F.col("r_start_us").alias("s"), F.col("r_end_us").alias("e"))
    got = overlap_join(cues, regions, width).groupBy("l_ep", f"l_{key}").agg(F.min(r).alias("a"), F.max(r).alias("b"))
    return got.select(F.col("l_ep").alias("ep"), F.col(f"l_{key}").alias(key), F.col("a.s").alias("first_start"), F.col("b.e").alias("last_end"))


def cue_words(cues: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """Pairs of cue and word whose times meet, ends included."""
    return overlap_join(cues, words, width, touching=True).select(F.col("l_ep").alias("ep"), F.col("l_cue_id").alias("cue_id"), F.col("r_word_idx").alias("word_idx"))


def repeated_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tokens that both sides of an episode have and one side repeats. Sides are (ep, token), or (ep, tokens): pieces, each an array of tokens."""
    token = lambda d: F.explode("tokens").alias("token") if "tokens" in d.columns else F.col("token")
    n = lambda d, c: d.select("ep", token(d)).groupBy("ep", "token").agg(F.count("*").alias(c))
    return n(left, "n_left").join(n(right, "n_right"), ["ep", "token"]).where("n_left > 1 or n_right > 1")


def extent(words: DataFrame) -> DataFrame:
    """An episode's first and last time, and the residual that makes an outlier: 12 s at most."""
    d = words.groupBy("ep").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    return d.withColumn("limit_us", F.least(F.lit(12_000_000), F.floor((F.col("last_us") - F.col("first_us")) / 10)).cast("long"))


def apply_forced(cues: DataFrame, forced: DataFrame, fps: float, min_ms: int) -> DataFrame:
    """Cues take their forced times, on frames, at 0 or later and ``min_ms`` long at least."""
    last = forced.groupBy("ep", "cue_id").agg(F.max_by(F.struct("f_start", "f_end"), "seq").alias("f"))
    start = F.when(F.col("f").isNotNull(), F.greatest(F.lit(0), snap_floor(F.col("f.f_start"), fps)))
    d = cues.join(last, ["ep", "cue_id"], "left").withColumn("new_start", F.coalesce(start, F.col("start_ms")).cast("long"))
    end = F.greatest(snap_ceil(F.col("f.f_end"), fps), snap_ceil(F.col("new_start") + min_ms, fps))
    d = d.withColumn("new_end", F.when(F.col("f").isNotNull(), end).otherwise(F.col("end_ms")).cast("long"))
    return d.withColumn("changed", (F.col("new_start") != F.col("start_ms")) | (F.col("new_end") != F.col("end_ms"))).drop("f")


def positional_merge(base: DataFrame, added: DataFrame) -> DataFrame:
    """Added cues go before the first base cue that starts later; the base keeps its order."""
    low = Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = base.select("ep", "pos", "cue_id", "start_ms").withColumn("reach", F.max("start_ms").over(low))
    both = b.select("ep", F.col("reach").alias("t"), F.lit(1).alias("side"), "pos", "cue_id").unionByName(added.select("ep", F.col("start_ms").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("pos"), "cue_id"))
    # base cues in their order carry the highest start so far: an added cue stands before the first that passes its own
    order = Window.partitionBy("ep").orderBy("t", F.desc("side"), F.col("pos").asc_nulls_last(), "cue_id")
    return both.select("ep", "cue_id", (F.row_number().over(order) - 1).cast("long").alias("place"))


def silent_removal(cues: DataFrame, inserted: DataFrame, silent: DataFrame) -> DataFrame:
    """Inserted cues without any speech go."""
    gone = inserted.select("ep", "cue_id").join(silent.select("ep", "cue_id").distinct(), ["ep", "cue_id"], "left_semi")
    return cues.join(gone, ["ep", "cue_id"], "left_anti")


def reject_generated(added: DataFrame, limits: DataFrame, toks: Column, slack_us: int = 5_000_000) -> DataFrame:
    """Why a generated cue is refused: it repeats itself or lies outside the source's extent."""
    d = added.join(limits.select("ep", "first_us", "last_us"), "ep", "left")
    start, end = F.coalesce("start_us", "end_us"), F.coalesce("end_us", "start_us")
    outside = (end < F.col("first_us") - slack_us) | (start > F.col("last_us") + slack_us)
    return d.withColumn("reason", F.when(repetitive(toks), "repetitive").when(outside, "outside")).drop("first_us", "last_us")


def fresh_ids(cues: DataFrame, added: DataFrame) -> DataFrame:
    """Added cues are numbered on from the episode's largest id, in order of time."""
    top = cues.groupBy("ep").agg(F.max("cue_id").alias("top"))
    nth = F.row_number().over(Window.partitionBy("ep").orderBy("start_us", "end_us", "seq"))
    return added.withColumn("nth", nth).join(top, "ep", "left").withColumn("cue_id", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("long")).drop("top", "nth")


def speaker_map_flags(mapping: DataFrame) -> DataFrame:
    """One information per mapped speaker, unknown ones left out."""
    return mapping.where("lower(character) <> 'unknown'").select("ep", F.lit("speaker_character_mapped").alias("kind"), F.lit("info").alias("severity"), F.concat("speaker", F.lit(" -> "), "character").alias("message"))


def sentence_initial(tokens: DataFrame) -> DataFrame:
    """Whether a token (ep, idx, token, trailing signs) begins a sentence, across cues."""
    ended = F.lag("signs").over(Window.partitionBy("ep").orderBy("idx"))
    return tokens.withColumn("initial", F.coalesce(ended.rlike("[.!?…]"), F.lit(True)))


def fps_flags(found: DataFrame, given: float) -> DataFrame:
    """A given frame rate that a confident detection contradicts, or a detection without confidence."""
    kind = F.when(F.col("confident") & (F.abs(F.lit(given) - F.col("fps")) > 0.05), "fps_override_mismatch").when(~F.col("confident"), "fps_detection_low_confidence")
    return found.withColumn("kind", kind).where("kind is not null")


def storage(jobs: DataFrame) -> DataFrame:
    """Bytes by owner, each job counting what it has or what was set aside, if more."""
    return jobs.groupBy("owner").agg(F.sum(F.greatest("actual", "reserved")).alias("bytes"))


def admission(jobs: DataFrame, most: int, more: int = 1) -> DataFrame:
    """Waiting and running jobs by owner, and whether ``more`` may come."""
    busy = F.count(F.when(F.col("status").isin("queued", "processing"), 1))
    return jobs.groupBy("owner").agg(busy.alias("busy")).withColumn("admitted", F.col("busy") + more <= most)
