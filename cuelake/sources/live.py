"""Services outside the engine: what each is asked and answers, and how tables go through one.

No service is called from here. An adapter is an object with the one method of its protocol; it is
sent to the tasks, makes its client there, and answers for one item at a time. ``ask`` runs it over a
table. What services answer is brought to the engine's columns by projections, which need no service.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "text string, start double, end double, confidence double, speaker_id string"
REGIONS = "start double, end double, confidence double"
FORCED = "cue_id long, start double, end double, score double"


class Transcriber(Protocol):
    """Words (text, start, end, confidence, speaker_id) of an audio file."""

    def answer(self, path: str) -> list[dict]: ...


class SpeechDetector(Protocol):
    """Where speech is (start, end, confidence)."""

    def answer(self, path: str) -> list[dict]: ...


class OverlapDetector(Protocol):
    """Where several speak (start, end, confidence), or turns (start, end, speaker)."""

    def answer(self, path: str) -> list[dict]: ...


class ForcedAligner(Protocol):
    """Times of known cues (cue_id, start, end, score)."""

    def answer(self, request: str) -> list[dict]: ...


class Adjudicator(Protocol):
    """Decisions (case_id, verdict, final_text, confidence) on a payload of spans."""

    def answer(self, payload: str) -> list[dict]: ...


class Punctuator(Protocol):
    """Texts (cue_id, proposed) for a payload of cues."""

    def answer(self, payload: str) -> list[dict]: ...


class SpeakerNamer(Protocol):
    """Characters (speaker, character) for a payload of samples."""

    def answer(self, payload: str) -> list[dict]: ...


class AudioProcessor(Protocol):
    """(seconds, bytes) of a file brought to 16 kHz mono."""

    def answer(self, path: str) -> list[dict]: ...


def ask(items: DataFrame, question: str, adapter, answers: str) -> DataFrame:
    """Each row's key columns with every answer to its column ``question``, and ``failed``: why there is none.

    An item that an adapter fails on gives one row without an answer; the others go on.
    """
    names = [a.split()[0] for a in answers.split(", ")]
    keys = [c for c in items.columns if c != question]
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, item in pdf.iterrows():
                key = [item[k] for k in keys]
                try:
                    found = adapter.answer(item[question])
                    rows += [[*key, *(a.get(n) for n in names), None] for a in found]
                except Exception as e:  # noqa: BLE001  any failure of a service is the item's own
                    rows.append([*key, *([None] * len(names)), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[*keys, *names, "failed"])

    return items.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), answers, "failed string"]))


def words_of(response: Column, times_in_ms: bool = False, word: tuple[str, ...] = ("text", "word"), speaker: tuple[str, ...] = ("speaker_id", "speaker")) -> Column:
    """An array of words from a service's JSON response with a list ``words``, whichever names it uses.

    Items without text, or of a type that is not ``word``, are left out; a confidence that is not given is 1.
    """
    item = "array<struct<type:string,text:string,word:string,start:double,end:double,confidence:double,score:double,speaker_id:string,speaker:string>>"
    unit = 1000.0 if times_in_ms else 1.0
    found = F.coalesce(F.from_json(response, f"struct<words:{item}>")["words"], F.flatten(F.from_json(response, f"struct<segments:array<struct<words:{item}>>>")["segments"]["words"]))
    text = lambda x: F.coalesce(*(F.nullif(x[w], F.lit("")) for w in word))
    spoken = F.filter(found, lambda x: (F.coalesce(x["type"], F.lit("word")) == "word") & text(x).isNotNull())
    return F.transform(
        spoken,
        lambda x: F.struct(
            text(x).alias("text"), (F.coalesce(x["start"], F.lit(0.0)) / unit).alias("start"), (F.coalesce(x["end"], F.lit(0.0)) / unit).alias("end"),
            F.coalesce(x["confidence"], x["score"], F.lit(1.0)).alias("confidence"), F.coalesce(*(F.nullif(x[s], F.lit("")) for s in speaker)).alias("speaker_id"),
        ),
    )
