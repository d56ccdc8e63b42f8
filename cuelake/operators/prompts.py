"""Payloads for language models: what a model is shown, as JSON, grouped by scene or speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(item: Column, *order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), item.alias("item")))), lambda x: x["item"])


def _payload(task: str, rules: list[str], **parts: Column) -> Column:
    return F.to_json(F.struct(F.lit(task).alias("task"), F.array(*map(F.lit, rules)).alias("instructions"), *(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"})


def adjudication(spans: DataFrame, gate: float = 0.7) -> DataFrame:
    """Ep, batch, payload of spans (ep, batch, nth, case_id, srt_text, asr_text, start, end, confidence)."""
    item = F.struct("case_id", "srt_text", "asr_text", "start", "end", "confidence")
    rules = ["Decide for each span what was spoken: keep_srt, use_audio or hybrid.", "final_text replaces the span alone.", f"Say so by a confidence below {gate} where the evidence is weak."]
    return spans.groupBy("ep", "batch").agg(_listed(item, "nth").alias("spans")).select("ep", "batch", _payload("decide divergent spans", rules, allowed_verdicts=F.array(*map(F.lit, ("keep_srt", "use_audio", "hybrid"))), confidence_gate=F.lit(gate), spans=F.col("spans")).alias("payload"))


def punctuation(cues: DataFrame) -> DataFrame:
    """Ep, batch, payload of cues (ep, batch, pos, cue_id, text, speaker, character)."""
    item = F.struct("cue_id", "text", F.col("speaker").alias("speaker_id"), "character")
    rules = ["Return every cue once.", "Change punctuation and case alone: no word, line break or quotation mark."]
    return cues.groupBy("ep", "batch").agg(_listed(item, "pos").alias("cues")).select("ep", "batch", _payload("punctuate cues", rules, cues=F.col("cues")).alias("payload"))


def speaker_samples(cues: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` cues of each known speaker of an episode."""
    nth = F.row_number().over(Window.partitionBy("ep", "speaker").orderBy("pos"))
    return cues.where("speaker <> ''").withColumn("nth", nth).where(F.col("nth") <= most)


def speakers(cues: DataFrame, most: int = 8) -> DataFrame:
    """Ep, payload: each speaker with samples of what it says."""
    each = speaker_samples(cues, most).groupBy("ep", "speaker").agg(_listed(F.struct("cue_id", "text"), "nth").alias("samples"))
    item = F.struct(F.col("speaker").alias("speaker_id"), "samples")
    rules = ["Name the character of each speaker from what it says.", "Answer unknown rather than guess."]
    return each.groupBy("ep").agg(_listed(item, "speaker").alias("speakers")).select("ep", _payload("name speakers", rules, speakers=F.col("speakers")).alias("payload"))
