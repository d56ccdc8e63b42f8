"""Decisions on divergent spans become edits of cues, new cues, removals and findings.

A case is a span with its decision: ep, nth (order), case_id, verdict, final_text, confidence, reason,
cue_ids, srt_text, asr_text, token_idx and word_idx (places in the episode), start and end (seconds),
speaker_ids, left_cue, right_cue, insert_at, left_end, right_start, left_speaker, right_speaker (of the
anchors of a span without cues), speaker and character (of the decision). Cases meet their cues by
joins, each case is judged by itself, and a cue's edits are applied where they are grouped by cue.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ROWS, find_bounds, flow, in_turn, indel_series, repetitive, signature, signature_of, split_for_cues, split_tokens, token_spans
from ..sources.kept import kept
from .intervals import overlap_join
from .recurrences import per_episode

ENDING = re.compile(r"([,.;:!?…]+)\s*$")


def plain_text(text: Column) -> Column:
    """A cue's lines, trimmed, blank ones left out, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def with_characters(cues: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cues whose speaker is in (ep, speaker, character) take the character; others keep theirs."""
    named = mapping.groupBy("ep", "speaker").agg(F.max("character").alias("__named"))
    return cues.join(named, ["ep", "speaker"], "left").withColumn("character", F.coalesce("__named", "character")).drop("__named").select(*cues.columns)


def partial(bounds: Column, n_tokens: Column, n_span: Column) -> Column:
    """Whether a span's (first, last) tokens are less than its cue's; without bounds, whether it has fewer."""
    return F.when(bounds.isNotNull(), (bounds["first"] != 0) | (bounds["last"] != n_tokens)).otherwise((n_span > 0) & (n_span < n_tokens))


# ---- where generated text goes


def rejections(cues: DataFrame, cases: DataFrame, slack: float = 5.0) -> DataFrame:
    """Ep, nth, reason of generated cases that repeat themselves or lie outside the source's cues."""
    limits = cues.groupBy("ep").agg((F.min("start_ms") / 1000.0).alias("first"), (F.max("end_ms") / 1000.0).alias("last"))
    d = _generated(cases).withColumn("said", signature(F.col("final_text"))).join(limits, "ep", "left")
    start, end = F.coalesce("start", "end"), F.coalesce("end", "start")
    outside = (end < F.col("first") - slack) | (start > F.col("last") + slack)
    reason = F.when(repetitive(F.col("said")), "adlib_rejected_repetitive_content").when(outside, "adlib_rejected_outside_source_span")
    return d.select("ep", "nth", reason.alias("reason")).where("reason is not null")


def _generated(cases: DataFrame) -> DataFrame:
    return cases.where((F.coalesce("verdict", F.lit("keep_srt")) != "keep_srt") & (F.size(F.coalesce("cue_ids", F.array().cast("array<long>"))) == 0) & (F.trim(F.coalesce("final_text", F.lit(""))) != ""))


def anchored_cue(cases: DataFrame, cues: DataFrame, gap: float = 0.2, further: float = 1.0) -> DataFrame:
    """Ep, nth, cue_id of generated cases that belong into the cue of one of their anchors.

    Both anchors in one cue; else, for up to three tokens, the right one if it follows closely (or, after a
    comma, of the same single speaker, within ``further``), or the left one if the text follows it
    closely and its cue does not end a sentence, or one token of the same single speaker touches it.
    """
    ids = cues.select("ep", F.col("cue_id"), plain_text(F.col("text")).alias("plain"))
    left = ids.select("ep", F.col("cue_id").alias("left_cue"), F.col("plain").alias("left_plain"))
    right = ids.select("ep", F.col("cue_id").alias("right_cue"), F.lit(True).alias("right_there"))
    d = _generated(cases).join(left, ["ep", "left_cue"], "left").join(right, ["ep", "right_cue"], "left")
    n = F.size(signature(F.col("final_text"), once=True))
    fits = lambda who: (F.size("speaker_ids") == 0) | who.isNull() | F.array_contains("speaker_ids", who)
    sure = lambda who: who.isNotNull() & (F.size(F.array_distinct("speaker_ids")) == 1) & (F.get("speaker_ids", 0) == who)
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = F.col("left_plain").isNotNull()
    inside = yes((F.col("left_cue") == F.col("right_cue")) & F.col("insert_at").isNotNull()) & there
    ahead, behind = F.col("right_start") - F.col("end"), F.col("start") - F.col("left_end")
    late = F.col("left_end").isNull() | F.col("start").isNull() | (F.col("start") >= F.col("left_end") - 0.05)
    goes_on = (ahead >= 0) & (ahead <= further) & F.col("final_text").rlike(r"[,;:]\s*$") & sure(F.col("right_speaker"))
    to_right = yes(F.col("right_there")) & yes((n <= 3) & fits(F.col("right_speaker")) & late & (((ahead >= -0.05) & (ahead <= gap)) | goes_on))
    open_end = ~F.col("left_plain").rlike(r"[.!?…]\s*$") | ((n == 1) & (behind >= -0.05) & (behind <= 0.05) & sure(F.col("left_speaker")))
    to_left = there & yes((n <= 3) & fits(F.col("left_speaker")) & (behind >= -0.05) & (behind <= gap) & open_end)
    d = d.withColumn("cue_id", F.when(inside, F.col("left_cue")).when(to_right, F.col("right_cue")).when(to_left, F.col("left_cue")))
    return d.where("cue_id is not null").select("ep", "nth", "cue_id")


def reconciled_cues(cases: DataFrame, unmatched: DataFrame, width_us: int, pad: float = 3.0, least: float = 80.0) -> DataFrame:
    """Ep, nth, cue_id of generated cases that say what a nearby unmatched cue (ep, cue_id, start_ms, end_ms, text) says.

    Times with ``pad`` seconds around must meet and texts be ``least`` alike. Cases in their order take
    the cue most like them, the earlier among equals, each cue once.
    """
    us = lambda c: (c * 1_000_000).cast("long")
    start, end = F.coalesce("start", "end"), F.coalesce("end", "start")
    said = F.array_join(signature(F.col("final_text")), " ")
    spans = _generated(cases).where("start is not null or end is not null").select("ep", "nth", us(start - pad).alias("start_us"), us(end + pad).alias("end_us"), said.alias("said"))
    there = unmatched.select("ep", "cue_id", F.col("start_ms").alias("at"), (F.col("start_ms") * 1000).alias("start_us"), (F.col("end_ms") * 1000).alias("end_us"), F.array_join(signature(F.col("text")), " ").alias("reads"))
    pairs = overlap_join(spans, there, width_us, touching=True).withColumn("ratio", indel_series(F.col("l_said"), F.col("r_reads"))).where(F.col("ratio") >= least)

    def greedy(rows):
        best: dict = {}
        for r in rows:
            best.setdefault(r["nth"], []).append((-r["ratio"], r["at"], r["cue_id"]))
        used, out = set(), []
        for nth in sorted(best):
            free = [x for x in sorted(best[nth]) if x[2] not in used]
            if free:
                used.add(free[0][2])
                out.append({"ep": rows[0]["ep"], "nth": nth, "cue_id": free[0][2]})
        return out

    found = pairs.select(F.col("l_ep").alias("ep"), F.col("l_nth").alias("nth"), F.col("r_cue_id").alias("cue_id"), F.col("r_at").alias("at"), "ratio")
    return per_episode(found, greedy, "ep long, nth long, cue_id long", "nth")


def placements(cues: DataFrame, cases: DataFrame, unmatched: DataFrame, width_us: int) -> DataFrame:
    """Ep, nth, how, cue_id of every generated case: rejected, anchored, reconciled or a new cue.

    New cues are numbered on from the episode's largest id in the order of cases.
    """
    keys = ["ep", "nth"]
    refused = rejections(cues, cases).select(*keys, "reason")
    anchored = anchored_cue(cases, cues).select(*keys, "cue_id")
    judged = _generated(cases).select(*keys).join(refused, keys, "left").join(anchored, keys, "left")
    how = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("cue_id").isNotNull(), "anchored")
    judged = kept(judged.select(*keys, how.alias("how"), F.when(F.col("reason").isNull(), F.col("cue_id")).alias("cue_id")), "judged")
    rest = cases.join(judged.where("how is null").select(*keys), keys, "left_semi")
    taken = reconciled_cues(rest, unmatched, width_us).select(*keys, F.col("cue_id").alias("taken"))
    top = cues.groupBy("ep").agg(F.max("cue_id").alias("top"))
    new = F.col("how").isNull() & F.col("taken").isNull()
    number = F.sum(new.cast("long")).over(Window.partitionBy("ep").orderBy("nth"))
    fresh = F.when(new, F.coalesce("top", F.lit(0)) + number).cast("long")
    d = judged.join(taken, keys, "left").join(top, "ep", "left")
    return d.select(*keys, F.coalesce("how", F.when(F.col("taken").isNotNull(), "reconciled").otherwise("new")).alias("how"), F.coalesce("cue_id", "taken", fresh).alias("cue_id"))


# ---- one case, one cue: small helpers


def restore_ending_of(text: str, source: str) -> str:
    bare = text.rstrip()
    m = ENDING.search(source.rstrip())
    return text if not bare or ENDING.search(bare) or m is None else bare + m[1]


def bounds_in_cue(sig: list[str], offset: int, token_idx: list[int], srt_text: str) -> tuple[int, int] | None:
    """First token and the one after the last of a span within a cue; by text if no index is in it."""
    mine = [i - offset for i in token_idx if offset <= i < offset + len(sig)]
    return (min(mine), max(mine) + 1) if mine else find_bounds(sig, signature_of(srt_text))


def localised(sig: list[str], bounds: tuple[int, int], final: str, asr_text: str, word_idx: list[int]) -> str:
    """A decided text without what it repeats of the cue around the span; empty if nothing else is in it."""
    said, before, behind = signature_of(final), sig[: bounds[0]], sig[bounds[1] :]
    if not said or said == before + behind:
        return ""
    starts = lambda x, y: bool(y) and x[: len(y)] == y
    ends = lambda x, y: bool(y) and x[-len(y) :] == y and len(x) >= len(y)
    if not word_idx and not signature_of(asr_text) and (starts(behind, said) or ends(before, said)):
        return ""
    a, b = len(before) * starts(said, before), len(behind) * ends(said, behind)
    places = token_spans(final)
    if not a + b or a + b >= len(said) or len(places) != len(said):
        return final.strip()
    return final[places[a][0] if a else 0 : places[len(places) - b][0] if b else len(final)].strip()


def edit_tokens(text: str, edits: list[tuple[int, int, str]]) -> str:
    """E5: tokens first..last-1 become other text, in order of place; edits that reach into one before are left out.

    The rest keeps its signs. A replaced half of a contraction takes its apostrophe along, a hyphen
    after a replaced token and signs that the new text brings itself go; text put at the end stands
    before the closing signs.
    """
    places = token_spans(text)
    if not places:
        return restore_ending_of(" ".join(x.strip() for *_, x in edits if x.strip()), text)
    out, at, done, n = [], 0, 0, len(places)
    for first, last, new in sorted(edits, key=lambda e: e[:2]):
        first = min(max(0, first), n)
        last, new = min(max(first, last), n), new.strip()
        a = places[first][0] if first < n else len(text)
        b = places[last - 1][1] if last > first else a
        if first == last == n and new and (m := ENDING.search(text.rstrip())) and not ENDING.search(new):
            a = b = m.start(1)
        if last > first:
            if a > at and text[a - 1] in "'’":
                a, new = a - 1, new and f" {new}"
            if new and text[b : b + 1] == "-":
                b += 1
            if new and text[b : b + 1] and text[b] in ",.;:!?" and ENDING.search(new):
                b += 1
        if a < at or first < done:
            continue
        out += [text[at:a], f" {new} " if first == last and new else new]
        at, done = b, last
    joined = re.sub(r"\s+", " ", "".join([*out, text[at:]])).strip()
    return restore_ending_of(re.sub(r"\s+([,.;:!?…])", r"\1", joined), text)


def spliced(plain: str, srt_text: str, final: str) -> str:
    """A cue's text with a span, found by its wording, replaced."""
    sig, gone, new = signature_of(plain), signature_of(srt_text), final.strip()
    at = find_bounds(sig, gone) if sig and gone and len(gone) < len(sig) else None
    if at is None:
        return new
    tokens, said = split_tokens(plain), signature_of(new)
    before, behind = sig[: at[0]], sig[at[1] :]
    kept_before = [] if before and said[: len(before)] == before else tokens[: at[0]]
    kept_behind = [] if behind and said[-len(behind) :] == behind else tokens[at[1] :]
    return restore_ending_of(" ".join(x.strip() for x in [*kept_before, new, *kept_behind] if x.strip()), plain)


def in_parts(batches, rows: int = ROWS):
    """Arrow batches in parts, so that few rows are Python objects at once: texts of a whole batch would add up."""
    for batch in in_turn(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch


ACTION = "ep long, nth long, act string, cue_id long, first long, last long, text string, kind string, cue_ids array<long>, old_text string, new_text string"


def _decider(remove: bool, width: int, most: int):
    def act(c: dict) -> list[dict]:
        """One case's actions: edit (tokens of a cue), replace, remove, add, and flag."""
        cues = c["cues"]
        final, ids = c["final_text"] or "", [x["cue_id"] for x in cues]
        old = "\n".join(x["text"] for x in cues)
        out: list[dict] = []

        def do(act, cue_id=None, first=None, last=None, text=None):
            out.append({"act": act, "cue_id": cue_id, "first": first, "last": last, "text": text})

        def flag(kind, new, cue_ids=None, before=old):
            out.append({"act": "flag", "kind": kind, "cue_ids": ids if cue_ids is None else cue_ids, "old_text": before, "new_text": new})

        def lined(text):
            return "\n".join(flow(text, width, most))

        def bounds(x):
            return bounds_in_cue(signature_of(x["plain"]), x["offset"], c["token_idx"] or [], c["srt_text"] or "")

        if not final.strip():
            if len(cues) == 1:
                at, n, gone = bounds(cues[0]), len(signature_of(cues[0]["plain"])), signature_of(c["srt_text"] or "")
                if at is not None and at != (0, n):
                    do("edit", ids[0], *at, "")
                    flag("text_changed", edit_tokens(cues[0]["plain"], [(*at, "")]))
                    return out
                if at is None and gone and len(gone) < n:
                    text = spliced(cues[0]["plain"], c["srt_text"] or "", "")
                    do("replace", ids[0], text=text)
                    flag("text_changed", text)
                    return out
            if cues:
                if remove:
                    for i in ids:
                        do("remove", i)
                flag("dropped_adjudicated_cue" if remove else "dropped_line_candidate", "")
            return out
        if not cues:
            target = c["target"]
            if target is None:
                return out
            there = c["target_plain"]
            if there is None:
                do("add", target, text=final)
                flag("adlib_inserted", lined(final), [target], None)
                return out
            at = c["insert_at"] if c["left_cue"] == target == c["right_cue"] else 0 if c["right_cue"] == target else len(signature_of(there)) if c["left_cue"] == target else None
            if at is None:
                do("replace", target, text=final)
            else:
                do("edit", target, at, at, final)
                flag("text_changed", edit_tokens(there, [(at, at, final)]), [target], c["target_text"])
            return out
        if c["token_idx"]:
            if len(cues) == 1 and (at := bounds(cues[0])) is not None:
                text = localised(signature_of(cues[0]["plain"]), at, final, c["asr_text"] or "", c["word_idx"] or [])
                do("edit", ids[0], *at, text)
                flag("text_changed", edit_tokens(cues[0]["plain"], [(*at, text)]))
                return out
            if len(cues) > 1 and len(signature_of(final)) == 1:
                spots = [(k, x["cue_id"], bounds(x)) for k, x in enumerate(cues)]
                for k, i, at in spots:
                    if at is not None:
                        do("edit", i, *at, "" if k else final)
                if out:
                    flag("text_changed", final)
                    return out
        parts = [spliced(cues[0]["plain"], c["srt_text"] or "", final)] if len(cues) == 1 else split_for_cues(final, len(cues))
        for i, text in zip(ids, parts):
            do("replace" if text.strip() else "remove", i, text=text)
        flag("text_changed", "\n".join(lined(x) for x in parts if x.strip()))
        return out

    names = [x.split()[0] for x in ACTION.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = pa.schema([(n, kinds[t.split()[1]]) for n, t in zip(names, ACTION.split(", "))])

    def run(batches):
        for batch in in_parts(batches):
            rows = [{"ep": c["ep"], "nth": c["nth"], **a} for c in batch.to_pylist() for a in act(c)]
            yield pa.RecordBatch.from_pylist(rows, fields)

    return run


def actions(cues: DataFrame, cases: DataFrame, placed: DataFrame, drop_policy: str = "keep", width: int = 26, lines: int = 2) -> DataFrame:
    """What each case does to which cue; cases without decision or with ``keep_srt`` do nothing."""
    offset = F.coalesce(F.sum(F.size(signature(plain_text(F.col("text"))))).over(Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    c = cues.select("ep", "pos", "cue_id", "text", plain_text(F.col("text")).alias("plain"), offset.alias("offset"))
    some = cases.where("verdict is not null and verdict <> 'keep_srt'")
    each = some.select("ep", "nth", F.posexplode("cue_ids").alias("k", "cue_id")).join(c, ["ep", "cue_id"])
    met = each.groupBy("ep", "nth").agg(F.array_sort(F.collect_list(F.struct("k", "cue_id", "text", "plain", "offset"))).alias("cues"))
    target = placed.where("cue_id is not null").select("ep", "nth", F.col("cue_id").alias("target")).join(c.select("ep", F.col("cue_id").alias("target"), F.col("plain").alias("target_plain"), F.col("text").alias("target_text")), ["ep", "target"], "left")
    whole = some.join(met, ["ep", "nth"], "left").join(target, ["ep", "nth"], "left")
    whole = whole.withColumn("cues", F.coalesce("cues", F.array().cast("array<struct<k:int,cue_id:bigint,text:string,plain:string,offset:bigint>>")))
    needed = whole.select("ep", "nth", "final_text", "cue_ids", "srt_text", "asr_text", "token_idx", "word_idx", "left_cue", "right_cue", "insert_at", "cues", "target", "target_plain", "target_text")
    return needed.mapInArrow(_decider(drop_policy == "remove", width, lines), ACTION)


def _applier(width: int, lines: int):
    def run(batches):
        for batch in in_parts(batches):
            out = {"text": [], "edited": [], "gone": []}
            for r in batch.to_pylist():
                edits = [(e["first"], e["last"], e["text"] or "") for e in r["edits"] or []]
                text, gone, edited = r["text"], bool(r["removed"]), None
                if edits:
                    edited = edit_tokens(r["plain"], edits)
                    gone = gone or not signature_of(edited)
                    text = "\n".join(flow(edited, width, lines))
                elif r["replaced"] is not None:
                    text = "\n".join(flow(r["replaced"], width, lines))
                out["text"].append(text)
                out["edited"].append(edited)
                out["gone"].append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("ep"), batch.column("cue_id"), pa.array(out["text"], pa.string()), pa.array(out["edited"], pa.string()), pa.array(out["gone"], pa.bool_())], ["ep", "cue_id", "text", "edited", "gone"])

    return run


def changed_cues(cues: DataFrame, acts: DataFrame, width: int = 26, lines: int = 2) -> DataFrame:
    """ep, cue_id, text, edited, gone of cues that some action is on: edits come before replacements, the last of which counts."""
    on = lambda *names: F.col("act").isin(*names)
    grouped = acts.where(on("edit", "replace", "remove")).groupBy("ep", "cue_id").agg(
        F.array_sort(F.collect_list(F.when(on("edit"), F.struct("nth", "first", "last", "text")))).alias("edits"),
        F.max_by(F.when(on("replace"), F.col("text")), F.when(on("replace"), F.col("nth"))).alias("replaced"),
        F.max(on("remove")).alias("removed"),
    )
    met = cues.select("ep", "cue_id", "text", plain_text(F.col("text")).alias("plain")).join(grouped, ["ep", "cue_id"])
    return met.select("ep", "cue_id", "text", "plain", "edits", "replaced", "removed").mapInArrow(_applier(width, lines), "ep long, cue_id long, text string, edited string, gone boolean")


def apply_decisions(cues: DataFrame, cases: DataFrame, placed: DataFrame, width: int = 26, lines: int = 2, drop_policy: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(cues with changed texts, without removed ones, with new ones in their place; findings).

    Columns of the cues: ep, place, cue_id, start_ms, end_ms, text, speaker, character; new ones have those
    of their case, if it tells them. New cues go before the first cue that starts later. Findings: ep, nth,
    kind, severity, cue_ids, message, confidence, start, end, old_text, new_text; one of a single edited cue
    shows its text after all of its edits. What the cases do is worked out once and written.
    """
    acts = kept(actions(cues, cases, placed, drop_policy, width, lines), "acts")
    told = lambda d, *names: [F.col(c).cast("string").alias(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in names]
    changed = changed_cues(cues, acts, width, lines)
    whose = ("speaker", "character")
    base = cues.select("ep", "pos", "cue_id", "start_ms", "end_ms", F.col("text").alias("was"), *told(cues, *whose)).join(changed.drop("edited"), ["ep", "cue_id"], "left").where("gone is null or not gone")
    base = base.select("ep", "pos", "cue_id", "start_ms", "end_ms", F.coalesce("text", "was").alias("text"), *whose)
    times = cases.select("ep", "nth", (F.coalesce("start", F.lit(0.0)) * 1000).cast("long").alias("start_ms"), (F.coalesce("end", "start", F.lit(0.0)) * 1000).cast("long").alias("end_ms"), *told(cases, *whose))
    added = acts.where("act = 'add'").join(times, ["ep", "nth"]).select("ep", "cue_id", "start_ms", "end_ms", flowed(F.col("text"), width, lines).alias("text"), *whose)
    # the base keeps its order: each cue carries the highest start so far, and a new one stands before the first that passes its own
    reach = F.max("start_ms").over(Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = base.select("*", reach.alias("t"), F.lit(1).alias("side")).unionByName(added.select("*", F.lit(None).cast("long").alias("pos"), F.col("start_ms").alias("t"), F.lit(0).alias("side")))
    order = Window.partitionBy("ep").orderBy("t", F.desc("side"), F.col("pos").asc_nulls_last(), "end_ms", "cue_id")
    cues_out = both.select("ep", (F.row_number().over(order) - 1).cast("long").alias("place"), "cue_id", "start_ms", "end_ms", "text", *whose)
    one = changed.where("edited is not null").select("ep", F.col("cue_id").alias("__one"), "edited")
    flags = acts.where("act = 'flag'").withColumn("__one", F.when((F.size("cue_ids") == 1) & (F.col("kind") == "text_changed"), F.get("cue_ids", 0))).join(one, ["ep", "__one"], "left")
    why = cases.select("ep", "nth", "confidence", "start", "end", "verdict", *told(cases, "reason"))
    emptied = F.when(F.col("kind") == "dropped_adjudicated_cue", " returned empty text; removed by drop_policy.").otherwise(" returned empty spoken text; preserving source cue for review.")
    verdict = F.concat(F.lit("Adjudication verdict "), "verdict")
    message = F.when(F.col("kind").startswith("dropped_"), F.concat(verdict, emptied)).otherwise(F.concat(verdict, F.lit(": "), F.coalesce("reason", F.lit(""))))
    flags = flags.drop("text").join(why, ["ep", "nth"])
    return cues_out, flags.select("ep", "nth", "kind", F.lit("warning").alias("severity"), "cue_ids", message.alias("message"), "confidence", "start", "end", "old_text", F.coalesce("edited", "new_text").alias("new_text"))


def flowed(text: Column, width: int, lines: int) -> Column:
    """U7 on Arrow batches: a text on up to ``lines`` lines."""
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else "\n".join(flow(x, width, lines)))

    return F.pandas_udf(run, "string")(text)


def attach_words(cue_words: DataFrame, cases: DataFrame, placed: DataFrame) -> DataFrame:
    """(ep, cue_id, word_idx) of matched words and those of decided spans, dealt evenly to the span's cues.

    The words of a placed span go to its one cue.
    """
    decided = cases.where("verdict in ('keep_srt', 'use_audio', 'hybrid')").join(placed.where("cue_id is not null").select("ep", "nth", F.col("cue_id").alias("target")), ["ep", "nth"], "left")
    ids = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array_distinct("cue_ids"))
    d = decided.withColumn("ids", ids).where("size(ids) > 0 and size(word_idx) > 0").select("ids", "ep", F.size("ids").alias("k"), F.size("word_idx").alias("n"), F.posexplode("word_idx").alias("i", "word_idx"))
    size, extra = F.floor(F.col("n") / F.col("k")), F.col("n") % F.col("k")
    part = F.when(F.col("i") < extra * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    more = d.select("ep", F.get("ids", part.cast("int")).alias("cue_id"), F.col("word_idx").cast("long").alias("word_idx"))
    return cue_words.select("ep", "cue_id", "word_idx").unionByName(more).distinct()


# ---- decisions before they are applied


def keep_source(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without a language model every span keeps its source, with its own confidence; and a finding each."""
    decided = spans.select("ep", "case_id", F.lit("keep_srt").alias("verdict"), F.col("srt_text").alias("final_text"), "confidence")
    return decided, spans.select("ep", "case_id", F.lit("divergence_unresolved").alias("kind"), "cue_ids", F.lit("warning").alias("severity"))


def validate(spans: DataFrame, first: DataFrame, retry=None) -> tuple[DataFrame, DataFrame]:
    """(a valid decision for every span, findings of those without).

    ``first`` are responses (ep, case_id, verdict, final_text, confidence; answered, their order): the last
    valid one counts, without an order the surest. In whole it is ``adjudicate.adjudicate``. Spans without a valid one are
    asked again once by ``retry`` (a function of these spans, or none); what then lacks one keeps its
    source with confidence 0.
    """
    last = lambda d: F.struct(*(["answered"] if "answered" in d.columns else []), "confidence", "verdict", "final_text")
    good = lambda d: d.where("verdict in ('keep_srt', 'use_audio', 'hybrid') and final_text is not null and confidence between 0 and 1").groupBy("ep", "case_id").agg(F.max(last(d)).alias("d")).select("ep", "case_id", "d.verdict", "d.final_text", "d.confidence")
    keys = ["ep", "case_id"]
    have = good(first).join(spans.select(*keys), keys, "left_semi")
    if retry is not None:
        again = good(retry(spans.join(have, keys, "left_anti"))).join(have, keys, "left_anti").join(spans.select(*keys), keys, "left_semi")
        have = have.unionByName(again)
    lost = spans.join(have.select(*keys), keys, "left_anti")
    kept = lost.select(*keys, F.lit("keep_srt").alias("verdict"), F.col("srt_text").alias("final_text"), F.lit(0.0).alias("confidence"))
    return have.unionByName(kept), lost.select(*keys, F.lit("invalid_llm_response").alias("kind"), F.lit("error").alias("severity"))
