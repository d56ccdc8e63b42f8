"""Findings of the last checks as rows: speech under a cue, spans that shrank, generated cues without speech.

Every finding is (ep, kind, severity, cue_ids, message, confidence, start, end, old_text, new_text), times in
seconds, as the report has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import region_coverage

COLUMNS = ("ep", "kind", "severity", "cue_ids", "message", "confidence", "start", "end", "old_text", "new_text")


def finding(d: DataFrame, kind: str, message: Column, severity: str = "warning", **values: Column) -> DataFrame:
    """Rows of ``d`` as findings; what is not given is null."""
    kinds = {"confidence": "double", "start": "double", "end": "double", "old_text": "string", "new_text": "string"}
    rest = {c: values[c].cast(k) if c in values else F.lit(None).cast(k) for c, k in kinds.items()}
    return d.select("ep", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), values["cue_ids"].alias("cue_ids"), message.alias("message"), *(v.alias(c) for c, v in rest.items()))


def percent(share: Column) -> Column:
    """A share as whole per cent; halves go to the even neighbour."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def speech_findings(cues: DataFrame, regions: DataFrame, width_us: int, least: float = 0.2, most_silent_ms: int = 300) -> DataFrame:
    """cue_without_speech_activity and cue_with_excessive_trailing_silence of (ep, cue_id, start_ms, end_ms, text).

    A cue whose regions cover less than ``least`` of it, overlapping regions each counting; and one that
    stays for more than ``most_silent_ms`` after the last speech in it. Cues of no duration or without times
    have no coverage; cues without any speech have no trailing silence.
    """
    c = cues.where("start_ms is not null and end_ms is not null").withColumns({"start_us": F.col("start_ms") * 1000, "end_us": F.col("end_ms") * 1000})
    c = region_coverage(c.select("ep", "cue_id", "text", "start_us", "end_us"), regions, "cue_id", width_us)
    sec = lambda x: x / 1e6
    share = F.col("covered_us") / (F.col("end_us") - F.col("start_us"))
    ids = F.array(F.col("cue_id").cast("long"))
    said = F.concat(F.lit("Cue overlaps speech activity for only "), percent(share), F.lit(" of its duration."))
    low = finding(c.where(F.col("end_us") > F.col("start_us")).where(share < least), "cue_without_speech_activity", said, cue_ids=ids, confidence=F.round(share, 3), start=sec(F.col("start_us")), end=sec(F.col("end_us")), old_text=F.col("text"))
    last = F.least("end_us", "last_us")
    silent = F.bround((F.col("end_us") - last) / 1000, 0).cast("long")
    told = F.format_string("Cue remains visible for %d ms after the last detected speech activity; limit is %d ms.", silent, F.lit(most_silent_ms))
    trailing = finding(c.where("last_us is not null").where(silent > most_silent_ms), "cue_with_excessive_trailing_silence", told, cue_ids=ids, start=sec(last), end=sec(F.col("end_us")), old_text=F.col("text"))
    return low.unionByName(trailing)


def span_findings(spans: DataFrame, source: DataFrame, rebuilt: DataFrame, least: float = 0.5) -> DataFrame:
    """span_coverage_low of decided spans (ep, nth, cue_ids, srt_text, verdict, final_text) that shrank.

    The window of a span's cues in ``rebuilt`` lasts less than ``least`` of that in ``source``; none at all
    counts as 0. Kept and undecided spans, and those without cues in the source, are left alone.
    """
    decided = spans.where("verdict is not null and verdict <> 'keep_srt'")
    each = decided.select("ep", "nth", F.explode(F.array_distinct("cue_ids")).alias("cue_id"))
    window = lambda d, a, b: each.join(d.select("ep", "cue_id", "start_ms", "end_ms"), ["ep", "cue_id"]).groupBy("ep", "nth").agg(F.min("start_ms").alias(a), F.max("end_ms").alias(b))
    d = decided.join(window(source, "a", "b"), ["ep", "nth"]).join(window(rebuilt, "x", "y"), ["ep", "nth"], "left")
    ratio = F.coalesce(F.greatest(F.lit(0), F.col("y") - F.col("x")), F.lit(0)) / F.greatest(F.lit(1), F.col("b") - F.col("a"))
    said = F.concat(F.lit("Adjudicated replacement covers only "), percent(ratio), F.lit(" of the source span; hold for editor review before accepting compressed dialogue."))
    return finding(d.where(ratio < least), "span_coverage_low", said, "error", cue_ids=F.col("cue_ids"), start=F.col("a") / 1000, end=F.col("b") / 1000, old_text=F.col("srt_text"), new_text=F.col("final_text"))


def without_silent_adlibs(cues: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, findings) without generated cues under which no speech was found at all.

    A cue that an adlib_inserted names and a cue_without_speech_activity of confidence 0 too goes. With it go
    its insertion and every finding of speech activity that names it; one that tells of the removal comes.
    """
    named = findings.select("ep", "kind", "confidence", F.explode("cue_ids").alias("cue_id"))
    silent = named.where("kind = 'cue_without_speech_activity' and confidence <= 0").select("ep", "cue_id").distinct()
    gone = named.where("kind = 'adlib_inserted'").select("ep", "cue_id").distinct().join(silent, ["ep", "cue_id"], "left_semi")
    lists = gone.groupBy("ep").agg(F.collect_set("cue_id").alias("__gone"))  # an episode's generated cues
    stale = F.col("kind").isin("adlib_inserted", "cue_without_speech_activity") & F.coalesce(F.arrays_overlap("cue_ids", "__gone"), F.lit(False))
    left = findings.join(lists, "ep", "left").where(~stale).select(*COLUMNS)
    said = F.lit("Generated ad-lib cue was removed because VAD found no speech activity in its displayed interval.")
    removed = cues.join(gone, ["ep", "cue_id"], "left_semi")
    told = finding(removed, "adlib_removed_without_speech_activity", said, cue_ids=F.array(F.col("cue_id").cast("long")), start=F.col("start_ms") / 1000, end=F.col("end_ms") / 1000, old_text=F.col("text"), new_text=F.lit(""))
    return cues.join(gone, ["ep", "cue_id"], "left_anti"), left.unionByName(told)
