"""Predicted cues against golden ones: content first, times after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.text import signature
from .align import edit_script, paired
from .apply_decisions import plain_text

CHANGES = ("text_changed", "adlib_inserted")


def matched_cues(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """Ep, cue_id, golden_id, score, exact of cues paired in order by their wording alone.

    A cue's key is its signature joined by blanks; what pairs, alike or not, is as in ``align_tokens``.
    Numbers and times of cues don't count, so an inserted cue shifts nothing.
    """

    def keyed(d: DataFrame) -> DataFrame:
        return d.select("ep", "pos", "cue_id", F.array_join(signature(plain_text(F.col("text"))), " ").alias("key"))

    def run(ep, a: dict, b: dict) -> list[tuple]:
        left, right = a["key"], b["key"]
        return [(ep, a["cue_id"][i], b["cue_id"][j], s, left[i] == right[j] != "") for kind, i, j, s in edit_script(left, right) if kind in ("match", "replace")]

    kinds = [("ep", predicted.schema["ep"].dataType), ("cue_id", LongType()), ("golden_id", LongType()), ("score", DoubleType()), ("exact", BooleanType())]
    return paired(keyed(predicted), keyed(golden), ["pos", "cue_id", "key"], run, StructType([StructField(*k) for k in kinds]))


def _share(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def timing_metrics(predicted: DataFrame, golden: DataFrame, pairs: DataFrame, flags: DataFrame | None = None, style_violations: DataFrame | None = None, fps: float = 30.0, least: float = 0.85) -> DataFrame:
    """An episode's counts, start errors of matched cues, share of cues with findings, and targets met.

    flags: (ep, cue_ids). style_violations: (ep, n). Episodes without a golden cue have null errors.
    """
    sizes = predicted.groupBy("ep").agg(F.count("*").alias("cue_count_predicted")).join(golden.groupBy("ep").agg(F.count("*").alias("cue_count_golden")), "ep", "left").fillna(0, ["cue_count_golden"])
    near = pairs.where(F.col("score") >= least).join(predicted.select("ep", "cue_id", "start_ms"), ["ep", "cue_id"])
    near = near.join(golden.select("ep", F.col("cue_id").alias("golden_id"), F.col("start_ms").alias("gold_ms")), ["ep", "golden_id"])
    miss, frame = F.abs(F.col("start_ms") - F.col("gold_ms")), 1000.0 / fps if fps > 0 else 0.0
    within = lambda k: F.round(F.avg((miss <= k * frame).cast("double")), 6)
    timed = near.groupBy("ep").agg(F.count("*").alias("matched_cues"), F.round(F.avg(miss), 3).alias("start_mae_ms"), within(1).alias("within_1"), within(3).alias("within_3"))
    out = sizes.join(timed, "ep", "left").fillna(0, ["matched_cues"])
    if flags is not None:
        some = flags.select("ep", F.explode("cue_ids").alias("cue_id")).distinct().groupBy("ep").agg(F.count("*").alias("n_flagged"))
        out = out.join(some, "ep", "left").fillna(0, ["n_flagged"])
    else:
        out = out.withColumn("n_flagged", F.lit(0).cast("long"))
    out = out.join(style_violations.select("ep", F.col("n").alias("style_violations")), "ep", "left").fillna(0, ["style_violations"]) if style_violations is not None else out.withColumn("style_violations", F.lit(0).cast("long"))
    out = out.withColumn("review_burden", F.coalesce(F.round(_share(F.col("n_flagged"), F.col("cue_count_predicted")), 6), F.lit(0.0))).drop("n_flagged")
    timing = F.coalesce((F.col("within_1") >= 0.9) & (F.col("within_3") >= 0.98) & (F.col("start_mae_ms") < 50), F.lit(False))
    same = (F.col("cue_count_predicted") == F.col("cue_count_golden")) & (F.col("style_violations") == 0)
    return out.withColumn("meets_timing", timing).withColumn("meets_structure", same).withColumn("meets_review", F.col("review_burden") <= 0.1)


def improv_metrics(predicted: DataFrame, flags: DataFrame, pairs: DataFrame, golden: DataFrame, source_pairs: DataFrame | None = None) -> DataFrame:
    """Tp, fp, fn, precision, recall of flagged text changes by episode.

    A predicted cue with such a flag (ep, kind, cue_ids) is right if its golden cue reads the same and,
    where the source was aligned too, that golden cue differs from the source or is new. Without the
    source, what was missed are unflagged predicted cues that read otherwise than their golden ones.
    """
    flagged = flags.where(F.col("kind").isin(*CHANGES)).select("ep", F.explode("cue_ids").alias("cue_id")).distinct().join(predicted.select("ep", "cue_id"), ["ep", "cue_id"], "left_semi")
    met = flagged.join(pairs, ["ep", "cue_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    if source_pairs is not None:
        kept = source_pairs.where("exact").select("ep", "golden_id")
        changed = golden.select("ep", F.col("cue_id").alias("golden_id")).join(kept, ["ep", "golden_id"], "left_anti").withColumn("changed", F.lit(True))
        met = met.join(changed, ["ep", "golden_id"], "left").withColumn("right", F.col("exact") & F.coalesce("changed", F.lit(False)))
        missed = changed.join(met.where("right").select("ep", "golden_id"), ["ep", "golden_id"], "left_anti").groupBy("ep").agg(F.count("*").alias("fn"))
    else:
        met = met.withColumn("right", F.col("exact"))
        missed = pairs.where("not exact").join(flagged, ["ep", "cue_id"], "left_anti").groupBy("ep").agg(F.count("*").alias("fn"))
    told = met.groupBy("ep").agg(F.count(F.when(F.col("right"), 1)).alias("tp"), F.count(F.when(~F.col("right"), 1)).alias("fp"))
    n = told.join(missed, "ep", "full_outer").fillna(0, ["tp", "fp", "fn"])
    share = lambda d: F.round(_share(F.col("tp"), F.col("tp") + F.col(d)), 6)
    return n.select("ep", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
