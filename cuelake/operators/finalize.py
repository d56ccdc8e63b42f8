"""The last pass over an episode's cues: order, repeats, reading speed, overlaps, each with its findings.

One ordered pass an episode yields both what becomes of the cues and what was found on the way, as rows
told apart by ``row`` ('cue' or 'finding'), so both come from one plan. A join of neighbours is one
operation with different rules: equal wording, cues that are read too fast, two speakers at once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import indel, signature_of, width_of
from .recurrences import frame_ceil, frame_floor, per_episode

ROWS = (
    "ep long, nth long, row string, cue_id long, kind string, severity string, cue_ids array<long>, message string, "
    "start_ms long, end_ms long, text string, speaker string, character string, old_text string, new_text string"
)


@dataclass(frozen=True)
class Finish:
    """fps, min_ms, zero_gap, lines and chars: the style. most_cps: none leaves reading speed alone.

    longest_ms: the most that a cue may last for its speed's sake. apart: whether overlaps are resolved.
    alike: how like two wordings are, in hundredths. overlap: stack, dash or flag_only.
    """

    fps: float = 30.0
    min_ms: int = 500
    zero_gap: bool = True
    lines: int = 2
    chars: int = 26
    most_cps: float | None = None
    longest_ms: int | None = None
    apart: bool = True
    alike: float = 90.0
    overlap: str = "stack"


def _plain(text: str) -> str:
    return " ".join(x.strip() for x in text.split("\n") if x.strip())


@functools.lru_cache(1 << 14)
def _wording(text: str) -> str:
    return " ".join(signature_of(_plain(text)))


def _others(a: dict, b: dict) -> bool:
    return any(a[c] and b[c] and a[c] != b[c] for c in ("speaker", "character"))


def _span(c: dict) -> str:
    return f"{c['start_ms'] / 1000.0:.3f} --> {c['end_ms'] / 1000.0:.3f}"


class _Findings(list):
    def add(self, kind: str, cues: list[dict], message: str, start: int, end: int, old: str | None = None, new: str | None = None, severity: str = "warning"):
        self.append({"kind": kind, "severity": severity, "cue_ids": [c["cue_id"] for c in cues], "message": message, "start_ms": start, "end_ms": end, "old_text": old, "new_text": new})


def joined(cues: list[dict], join: Callable[[dict, dict], dict | None], more: bool, note: Callable[[list[dict], dict], None]) -> list[dict]:
    """Neighbours that ``join`` makes one; with ``more`` the result may take in the next one too."""
    out, i = [], 0
    while i < len(cues):
        now, used = cues[i], 1
        while i + used < len(cues) and (more or used == 1) and (both := join(now, cues[i + used])) is not None:
            now, used = both, used + 1
        if used > 1:
            note(cues[i : i + used], now)
        out.append(now)
        i += used
    return out


def _known(a: dict, b: dict, name: str):
    return a[name] if a[name] == b[name] else a[name] or b[name]


def _repeats(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    """W11."""

    def join(a, b):
        x, y = (_wording(c["text"]) for c in (a, b)) if b["start_ms"] < a["end_ms"] else ("", "")
        if not x or not y or (x != y and indel(x, y) < p.alike):
            return None
        longer = b["end_ms"] - b["start_ms"] > a["end_ms"] - a["start_ms"] or len(_plain(b["text"])) > len(_plain(a["text"]))
        times = {"start_ms": min(a["start_ms"], b["start_ms"]), "end_ms": max(a["end_ms"], b["end_ms"])}
        return {"cue_id": min(a["cue_id"], b["cue_id"]), "text": (b if longer else a)["text"], **times, **{c: _known(a, b, c) for c in ("speaker", "character")}}

    def note(cs, c):
        found.add("duplicate_cue_merged", cs, "Duplicate overlapping cue text was merged into one output cue.", c["start_ms"], c["end_ms"], "\n\n".join(x["text"] for x in cs), c["text"])

    return joined(cues, join, True, note)


def _cps(width: int, ms: int) -> float:
    return width / (ms / 1000.0) if ms > 0 else float("inf")


def _slow_end(c: dict, p: Finish) -> int:
    """The first frame at which the cue is read slowly enough, or what it may last at most."""
    width, start = width_of(_plain(c["text"])), c["start_ms"]
    if not width:
        return c["end_ms"]
    end = frame_ceil(start + width / p.most_cps * 1000, p.fps)
    while _cps(width, end - start) > p.most_cps:
        end = max(frame_ceil(end + 1, p.fps), end + 1)
    return end if p.longest_ms is None else min(end, max(start + 1, frame_floor(start + p.longest_ms, p.fps)))


def _longer(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    out = []
    for c, after in zip(cues, [*cues[1:], None]):
        end = _slow_end(c, p)
        if end > c["end_ms"] and (after is None or end <= after["start_ms"]):
            new = c | {"end_ms": end}
            found.add("cps_duration_extended", [c], "Cue display duration was extended into the following display gap to stay within timing.max_cps.", c["start_ms"], end, _span(c), _span(new))
            c = new
        out.append(c)
    return out


def _fast_pairs(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    """W13."""

    def speed(c):
        ms = c["end_ms"] - c["start_ms"]
        return _cps(width_of(_plain(c["text"])), ms) if ms > 0 else 0.0

    def join(a, b):
        if speed(a) <= p.most_cps or _others(a, b) or p.lines < 2:
            return None
        lines, end = [_plain(a["text"]), _plain(b["text"])], max(a["end_ms"], b["end_ms"])
        both = a | {"end_ms": end, "text": "\n".join(lines), **{c: _known(a, b, c) for c in ("speaker", "character")}}
        fits = all(width_of(x) <= p.chars for x in lines) and speed(both) <= p.most_cps and (p.longest_ms is None or end - a["start_ms"] <= p.longest_ms)
        return both if fits else None

    def note(cs, c):
        found.add("cps_cue_merged", cs, "Adjacent cues were merged to satisfy timing.max_cps without creating overlaps.", c["start_ms"], c["end_ms"], "\n".join(x["text"] for x in cs), c["text"])

    return joined(cues, join, False, note)


def _apart(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    """W10."""
    out: list[dict] = []
    for c in cues:
        last = out[-1] if out else None
        others = last is not None and _others(last, c)
        if last is not None and (c["start_ms"] < last["end_ms"] or c["start_ms"] == last["end_ms"] and others):
            start = last["end_ms"] if p.zero_gap and not others else frame_ceil(last["end_ms"] + 1, p.fps)
            new = c | {"start_ms": start, "end_ms": max(c["end_ms"], frame_ceil(start + p.min_ms, p.fps))}
            kind, message = "output_overlap_resolved", "Residual output overlap was resolved during final ordering."
            if c["start_ms"] == last["end_ms"]:
                kind, message = "speaker_transition_gap_inserted", "A visible frame gap was inserted between different detected speakers."
            found.add(kind, [last, c], message, new["start_ms"], new["end_ms"], _span(c), _span(new))
            c = new
        out.append(c)
    return out


def _inversions(cues: list[dict], found: _Findings) -> None:
    """W15."""
    message = "Source cue order conflicts with chronological timing; final time sorting would reverse this narrative sequence. Acoustic timing review is required."
    for a, b in zip(cues, cues[1:]):
        if b["start_ms"] < a["start_ms"]:
            old = "\n".join(f"{c['cue_id']}: {c['text']}" for c in (a, b))
            found.add("output_order_inversion", [a, b], message, min(a["start_ms"], b["start_ms"]), max(a["end_ms"], b["end_ms"]), old, severity="error")


def _finished(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    _inversions(cues, found)
    cues = _repeats(sorted(cues, key=lambda c: (c["start_ms"], c["end_ms"], c["cue_id"])), p, found)
    if p.most_cps is not None:
        if p.most_cps > 0:
            cues = _longer(cues, p, found)
        cues = _fast_pairs(cues, p, found)
    return _apart(cues, p, found) if p.apart else cues


def _overlapping(cues: list[dict], p: Finish, found: _Findings) -> list[dict]:
    """Overlaps are found; under ``dash`` two known speakers at once become one cue first."""
    times = lambda a, b: (max(a["start_ms"], b["start_ms"]), min(a["end_ms"], b["end_ms"]))

    def join(a, b):
        if a["end_ms"] <= b["start_ms"] or a["speaker"] is None or b["speaker"] is None or a["speaker"] == b["speaker"]:
            return None
        return a | {"start_ms": min(a["start_ms"], b["start_ms"]), "end_ms": max(a["end_ms"], b["end_ms"]), "text": "\n".join(f"- {_plain(c['text'])}" for c in (a, b)), "speaker": None, "character": None}

    def note(cs, c):
        found.add("overlap_dash_merge", cs, "Overlapping speakers merged into a dashed two-line cue.", *times(*cs), "\n".join(x["text"] for x in cs), c["text"])

    if p.overlap == "dash":
        cues = joined(cues, join, False, note)
    for a, b in zip(cues, cues[1:]):
        if b["start_ms"] < a["end_ms"]:
            found.add("overlap_stacked" if p.overlap == "stack" else "overlap_flag_only", [a, b], "Overlapping speaker cues require QC review.", *times(a, b), f"{a['text']}\n{b['text']}")
    return cues


def _pass(cues: DataFrame, p: Finish, steps: Callable[[list[dict], Finish, _Findings], list[dict]]) -> DataFrame:
    if p.overlap not in ("stack", "dash", "flag_only"):
        raise ValueError(f"unsupported overlap policy: {p.overlap}")
    missing = [c for c in ("speaker", "character") if c not in cues.columns]
    d = cues.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else cues
    d = d.select("ep", "pos", F.col("cue_id").cast("long").alias("cue_id"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"), F.col("speaker").cast("string").alias("speaker"), F.col("character").cast("string").alias("character"))

    def fold(rows):
        found = _Findings()
        timed = [{k: v for k, v in r.items() if k not in ("ep", "pos")} for r in rows if r["start_ms"] is not None and r["end_ms"] is not None]
        rest = [{k: v for k, v in r.items() if k not in ("ep", "pos")} for r in rows if r["start_ms"] is None or r["end_ms"] is None]
        out = steps(timed, p, found) + rest
        return [{"ep": rows[0]["ep"], "nth": i, "row": row, **x} for row, xs in (("cue", out), ("finding", found)) for i, x in enumerate(xs)]

    return per_episode(d, fold, ROWS)


def finalize(cues: DataFrame, p: Finish = Finish()) -> DataFrame:
    """Cues (ep, pos, cue_id, start_ms, end_ms, text; speaker, character) as they go out, and the findings.

    Kinds: output_order_inversion, duplicate_cue_merged, cps_duration_extended, cps_cue_merged,
    output_overlap_resolved, speaker_transition_gap_inserted. A null text is an empty one. Cues that lack a
    time come last, as they are, and take no part. Rows that share a cue_id are cues of their own. Other
    columns are not read. An empty table gives no rows.
    """
    return _pass(cues, p, _finished)


def overlap_policy(cues: DataFrame, p: Finish = Finish()) -> DataFrame:
    """Cues in their order and what was found of overlaps: overlap_stacked, overlap_flag_only, overlap_dash_merge."""
    return _pass(cues, p, _overlapping)


def cues_of(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'cue'").select("ep", F.col("nth").alias("pos"), "cue_id", "start_ms", "end_ms", "text", "speaker", "character")


def findings_of(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'finding'").select("ep", "nth", "kind", "severity", "cue_ids", "message", "start_ms", "end_ms", "old_text", "new_text")
