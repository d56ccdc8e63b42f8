"""A punctuation pass that may change signs and line breaks, not words."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profanity import Masks, censor, censor_text
from ..functions.text import quote_signs, restore_breaks, width_of, word_breaks, word_freeze, wrap
from .recurrences import per_episode


def refusal(before: str, after: str) -> str | None:
    """Why a proposed text is refused; null if only signs other than quotation marks changed."""
    if word_freeze(before) != word_freeze(after):
        return "words changed"
    return "quotation marks changed" if quote_signs(before) != quote_signs(after) else None


def plain(text: str | None) -> str:
    return " ".join(x.strip() for x in (text or "").split("\n") if x.strip())


def relined(text: str, source: str | None, same_words: bool, width: int | None, most: int | None) -> str:
    """The proposed text on the source's lines where words did not change; wrapped anew where it then fits badly."""
    source_lines = (source or "").split("\n")
    lines = restore_breaks(source_lines, text) if same_words else text.splitlines() or [text]
    wide = width is not None and any(width_of(x) > width for x in lines)
    many = most is not None and len(lines) > most
    as_source = same_words and word_breaks(lines) == word_breaks(source_lines) and not many
    if (wide or many) and not as_source:
        flat = text.replace("\n", " ")
        lines = (wrap(flat, width) if width is not None else None) or [flat]
    return "\n".join(lines)


def punctuate(cues: DataFrame, proposed: DataFrame, source: DataFrame | None = None, width: int | None = None, lines: int | None = None) -> DataFrame:
    """Ep, cue_id, text, problem of every cue, after proposals (ep, cue_id, proposed).

    A proposal that changes words or quotation marks is refused and named in ``problem``. Cues without
    one stay. ``source`` (ep, cue_id, text) gives the line breaks that unchanged words keep; it is the
    cues themselves by default. Of several proposals for a cue the last by text counts.
    """
    one = proposed.groupBy("ep", "cue_id").agg(F.max("proposed").alias("proposed"))
    origin = (cues if source is None else source).select("ep", "cue_id", F.col("text").alias("source"))
    d = cues.select("ep", "cue_id", "text").join(one, ["ep", "cue_id"], "left").join(origin, ["ep", "cue_id"], "left")

    def run(batches):
        for batch in batches:
            texts, problems = [], []
            for text, new, src in zip(*(batch.column(c).to_pylist() for c in ("text", "proposed", "source"))):
                problem = None if new is None else refusal(plain(text), new.replace("\n", " "))
                if new is not None and problem is None:
                    text = relined(new, src, src is not None and word_freeze(plain(src)) == word_freeze(plain(text)), width, lines)
                texts.append(text)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([batch.column("ep"), batch.column("cue_id"), pa.array(texts, pa.string()), pa.array(problems, pa.string())], ["ep", "cue_id", "text", "problem"])

    return d.mapInArrow(run, "ep long, cue_id long, text string, problem string")


def censor_cues(cues: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Ep, pos, cue_id, text, changes of cues (ep, pos, cue_id, text) with profane words masked.

    Masks that the source's cues bring are used first, each once: the cue's own, else one that no
    word of its own cue waits for. ``changes`` lists what was replaced, as ``old>new``.
    """
    both = cues.select("ep", "pos", "cue_id", "text", F.lit(1).alias("side"))
    if source is not None:
        both = both.unionByName(source.select("ep", "pos", "cue_id", "text", F.lit(0).alias("side")))

    def fold(rows):
        out = [r for r in rows if r["side"]]
        masks = Masks([(r["cue_id"], r["text"]) for r in rows if not r["side"]], [(r["cue_id"], r["text"]) for r in out])
        done = []
        for r in out:
            text, changes = (None, []) if r["text"] is None else censor(r["text"], r["cue_id"], masks)
            done.append({"ep": r["ep"], "pos": r["pos"], "cue_id": r["cue_id"], "text": text, "changes": ", ".join(f"{a}>{b}" for a, b in changes)})
        return done

    return per_episode(both, fold, "ep long, pos long, cue_id long, text string, changes string")


def censored(text, source=None):
    """U16 for texts of their own, such as a finding's message: a Column on Arrow batches."""
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: censor_text(x, source))

    return F.pandas_udf(run, "string")(text)
