"""Divergent spans put to an adapter scene by scene, each answer checked, what is invalid asked once more.

A request holds the spans of one scene of an episode; scenes of an episode and of many go out side by
side. An answer is a list of payloads. A payload is for the span that its case_id names, else for the span
at its place in the request, which it then cannot decide. Answers are written before they are used, so that
no later step asks again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature
from ..sources.kept import kept
from .edits import triage
from .sequence import islands

# What may be decided, and the notes of decisions that no adapter made.
VERDICTS = ("keep_srt", "use_audio", "hybrid")
SAME = "Punctuation/casing-only difference; preserved source SRT."
NEAR = "Tiny ASR spelling/noise difference; preserved source SRT."
LOST = "Invalid LLM response; preserved source SRT."

DECIDED = "ep long, nth long, verdict string, final_text string, confidence double, speaker string, character string, reason string, valid boolean"
Asker = Callable[[list[dict]], object]


def decision_of(payload: object) -> dict | None:
    """A payload's decision; none if a field is missing, of another kind or out of bounds."""
    if not isinstance(payload, dict):
        return None
    text = lambda name: isinstance(payload.get(name), str)
    maybe = lambda name: payload.get(name) is None or text(name)
    try:
        sure = float(payload.get("confidence"))
    except (TypeError, ValueError):
        return None
    fine = text("case_id") and payload.get("verdict") in VERDICTS and text("final_text") and text("reason") and maybe("speaker") and maybe("character")
    if not fine or not 0 <= sure <= 1 or math.isnan(sure):
        return None
    return {"case_id": payload["case_id"], "confidence": sure, **{k: payload.get(k) for k in ("verdict", "final_text", "speaker", "character", "reason")}}


def checked(raw: object, spans: list[dict]) -> list[dict]:
    """A row for each span of a request: its last valid decision, if any, and whether nothing sent for it was invalid."""
    named = {s["case_id"]: i for i, s in enumerate(spans)}
    kept: dict[int, dict] = {}
    bad: set[int] = set()
    for place, payload in enumerate(raw if isinstance(raw, list) else []):
        i = named.get(str(payload.get("case_id"))) if isinstance(payload, dict) else None
        i = place if i is None and place < len(spans) else i
        if i is None:
            continue
        d = decision_of(payload)
        if d is None or d.pop("case_id") != spans[i]["case_id"]:
            bad.add(i)
        else:
            kept[i] = d
    none = dict.fromkeys(("verdict", "final_text", "confidence", "speaker", "character", "reason"))
    return [{"ep": s["ep"], "nth": s["nth"], **kept.get(i, none), "valid": i in kept and i not in bad} for i, s in enumerate(spans)]


def scenes(spans: DataFrame, gap: float = 4.0) -> DataFrame:
    """Adds ``batch``: a scene ends where the next span starts more than ``gap`` seconds after it; unknown times join."""
    w = Window.partitionBy("ep").orderBy("nth")
    first = F.lag("nth").over(w).isNull()
    return islands(spans, first | F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(False)), ["nth"], "batch")


def ask(spans: DataFrame, adapter: Asker, gap: float = 4.0) -> DataFrame:
    """A row for each span, as ``checked`` has them, of one request a scene."""
    columns = ["ep", "nth", "case_id", "srt_text", "asr_text", "start", "end", "speaker_ids"]
    request = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nth", *(c for c in columns if c != "nth")))), lambda x: x), {"ignoreNullFields": "false"})
    requests = scenes(spans, gap).groupBy("ep", "batch").agg(request.alias("request"))

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for text in pdf["request"] for r in _answer(adapter, json.loads(text))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECIDED.split(", ")])

    return kept(requests.mapInPandas(answered, DECIDED), "answers")


def _answer(adapter: Asker, spans: list[dict]) -> list[dict]:
    return checked(adapter([dict(s) for s in spans]), spans)


def adjudicate(spans: DataFrame, adapter: Asker, gate: float = 0.7, gap: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(a decision for every span, findings) of (ep, nth, case_id, cue_ids, srt_text, asr_text, start, end, confidence, speaker_ids).

    Spans that differ in signs, or little, keep their source without being asked about. A span for which
    an invalid payload came, or none, is asked about again with the invalid ones of its scene; a valid second
    answer counts before a first one. What then has none keeps its source with confidence 0 and the finding
    invalid_llm_response; a confidence below ``gate`` gives low_confidence_adjudication. Null texts count as
    empty. An empty table gives no rows.
    """
    s = spans.withColumns({"srt_text": F.coalesce("srt_text", F.lit("")), "asr_text": F.coalesce("asr_text", F.lit(""))})
    s = s.withColumns({"_a": signature(F.col("srt_text")), "_b": signature(F.col("asr_text"))})
    s = triage(s, "_a", "_b").withColumn("same", F.array_join("_a", " ") == F.array_join("_b", " ")).withColumnRenamed("verdict", "_verdict").drop("_a", "_b")
    open_ = s.where("_verdict = 'ask'")
    first = ask(open_, adapter, gap)
    again = ask(open_.join(first.where("not valid").select("ep", "nth"), ["ep", "nth"], "left_semi"), adapter, gap)
    named = lambda d, name: d.select("ep", "nth", F.when(F.col("verdict").isNotNull(), F.struct("verdict", "final_text", "confidence", "speaker", "character", "reason")).alias(name))
    d = s.join(named(first, "one"), ["ep", "nth"], "left").join(named(again, "two"), ["ep", "nth"], "left")
    own = lambda sure, why: F.struct(F.lit("keep_srt").alias("verdict"), F.col("srt_text").alias("final_text"), sure.alias("confidence"), F.get("speaker_ids", 0).alias("speaker"), F.lit("unknown").alias("character"), why.alias("reason"))
    told = own(F.col("confidence").cast("double"), F.when(F.col("same"), SAME).otherwise(NEAR))
    d = d.withColumn("d", F.when(F.col("_verdict") != "ask", told).otherwise(F.coalesce("two", "one", own(F.lit(0.0), F.lit(LOST)))))
    lost = (F.col("_verdict") == "ask") & F.col("one").isNull() & F.col("two").isNull()
    none = F.lit(None)
    found = F.array_compact(
        F.array(
            F.when(lost, F.struct(F.lit("invalid_llm_response").alias("kind"), F.lit("error").alias("severity"), F.lit("LLM response failed schema validation.").alias("message"), none.cast("double").alias("confidence"), F.col("asr_text").alias("new_text"))),
            F.when(F.col("d.confidence") < gate, F.struct(F.lit("low_confidence_adjudication").alias("kind"), F.lit("warning").alias("severity"), F.lit("Adjudication confidence is below the configured gate.").alias("message"), F.col("d.confidence").alias("confidence"), F.col("d.final_text").alias("new_text"))),
        )
    )
    findings = d.select("ep", "nth", "cue_ids", "start", "end", F.col("srt_text").alias("old_text"), F.explode(found).alias("f"))
    return d.select("ep", "nth", "case_id", "d.*"), findings.select("ep", "nth", "f.kind", "f.severity", "cue_ids", "f.message", "f.confidence", "start", "end", "old_text", "f.new_text")
