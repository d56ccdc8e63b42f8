"""Decisions, contexts and reports around divergent spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import indel_ratio, restore_ending
from ..sources.kept import kept
from .name_drift import similar_pairs


def triage(spans: DataFrame, source: str, heard: str) -> DataFrame:
    """Keep what is the same but for small differences in as many tokens; else ask.

    ``source`` and ``heard`` are arrays of normalized tokens.
    """
    a, b = F.array_join(source, " "), F.array_join(heard, " ")
    some = (F.size(source) > 0) & (F.size(heard) > 0)
    like = (F.size(source) == F.size(heard)) & (indel_ratio(a, b) >= 92)
    return spans.withColumn("verdict", F.when(some & (a == b), "keep_srt").when(some & like, "keep_srt").otherwise("ask"))


def scene_context(spans: DataFrame, cues: DataFrame, around: int = 2) -> DataFrame:
    """The cues up to ``around`` places before and after each span (ep, case_id, first_pos, last_pos).

    Each span asks for single positions, so the join is on equal keys.
    """
    want = spans.select("ep", "case_id", "first_pos", "last_pos", F.explode(F.sequence(F.col("first_pos") - around, F.col("last_pos") + around)).alias("pos"))
    want = want.where("pos < first_pos or pos > last_pos").withColumn("side", F.when(F.col("pos") < F.col("first_pos"), "before").otherwise("after"))
    return want.join(cues.select("ep", "pos", "cue_id", "text"), ["ep", "pos"]).select("ep", "case_id", "side", "pos", "cue_id", "text")


def last_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each span with the last decision made for it, if any."""
    last = decisions.groupBy("ep", "case_id").agg(F.max_by(F.struct("verdict", "final_text", "confidence"), "decided").alias("d"))
    return spans.join(last, ["ep", "case_id"], "left").select(*[spans[c] for c in spans.columns], "d.verdict", "d.final_text", "d.confidence")


def confidence_gate(decisions: DataFrame, gate: float = 0.7) -> DataFrame:
    """Decisions below the gate."""
    return decisions.where(F.col("confidence") < gate)


def replaced(cues: DataFrame, final: Column) -> DataFrame:
    """E4 for whole cues: a decided text takes the source's closing signs."""
    return cues.withColumn("text", F.when(final.isNotNull() & (F.trim(final) != ""), restore_ending(final, F.col("text"))).otherwise(F.col("text")))


def changes_diff(flags: DataFrame) -> DataFrame:
    """K3: a block of text for each flag that has texts: kind and cue, then old and new lines."""
    lines = lambda c, sign: F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.concat(F.lit(sign), x)), "\n")
    old = F.when(F.col("old_text") != "", lines(F.col("old_text"), "- "))
    new = F.when(F.col("new_text") != "", lines(F.col("new_text"), "+ "))
    head = F.concat(F.lit("# "), "kind", F.lit(" cue="), F.coalesce(F.col("cue_id").cast("string"), F.lit("ad-lib")))
    return flags.withColumn("old", old).withColumn("new", new).where("old is not null or new is not null").select("ep", "cue_id", "kind", F.concat_ws("\n", head, "old", "new").alias("diff"))


def first_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """Equal rows but for their order columns; the first stays."""
    keys = [c for c in rows.columns if c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("o")).select(*keys, "o.*")


# Names of parameters that never enter a key.
SECRETS = ("api_key", "access_token", "authorization", "auth_token", "hf_token", "password", "secret", "token")


def cache_keys(rows: DataFrame, *parts: str) -> DataFrame:
    """A digest of the parts as canonical JSON: names in order, nulls told apart, secrets left out."""
    kept = sorted(p for p in parts if p.lower() not in SECRETS)
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256))


def span_coverage(spans: DataFrame, source: DataFrame, rebuilt: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans (ep, case_id, cue_ids) whose rebuilt window is less than ``least`` of the source's."""
    each = spans.select("ep", "case_id", F.explode("cue_ids").alias("cue_id"))

    def extent(cues: DataFrame, name: str) -> DataFrame:
        return each.join(cues, ["ep", "cue_id"]).groupBy("ep", "case_id").agg((F.max("end_ms") - F.min("start_ms")).alias(name))

    both = extent(source, "was_ms").join(extent(rebuilt, "is_ms"), ["ep", "case_id"], "left").withColumn("is_ms", F.coalesce("is_ms", F.lit(0)))
    return both.withColumn("ratio", F.round(F.col("is_ms") / F.greatest(F.lit(1), F.col("was_ms")), 4)).where(F.col("ratio") < least)


def name_drift(tokens: DataFrame, known: DataFrame, least: float = 70.0, count: int = 2, share: float = 0.8) -> DataFrame:
    """J18 over one dictionary: tokens of four letters or more that ``known`` lacks, with the known token most like them.

    A known token that stands ``count`` times, within three letters of length and ``least`` alike, is
    a candidate; the most frequent one counts if it has ``share`` of all candidates' places. By episode,
    with kinds and cues, it is ``name_drift.name_drift_findings``.
    """
    given = kept(known.groupBy("token").agg(F.count("*").alias("known_n")), "given")
    new = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.length("token") >= 4).join(given, "token", "left_anti")
    often = given.where(F.col("known_n") >= count).withColumnRenamed("token", "known")
    one = F.lit(0).alias("ep")
    # likeness has no side: the words that are asked about offer their rarest letters
    pairs = similar_pairs(often.select(one, F.col("known").alias("key"), "known_n"), new.select(one, F.col("token").alias("known"), "n"), least, whole=True)
    pairs = pairs.select(F.col("known").alias("token"), F.col("key").alias("known"), "known_n", "n", "ratio")
    each = Window.partitionBy("token")
    best = each.orderBy(F.desc("known_n"), F.desc("ratio"), "known")
    ranked = pairs.withColumn("r", F.row_number().over(best)).withColumn("all_n", F.sum("known_n").over(each))
    return ranked.where((F.col("r") == 1) & (F.col("known_n") / F.col("all_n") >= share)).select("token", "n", "known", "ratio")


def pair_uploads(files: DataFrame) -> DataFrame:
    """Subtitle and audio names by their stem, wav before mp3; what lacks either is kept."""
    stem = F.upper(F.regexp_replace("name", r"\.[^.]*$", ""))
    kind = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    f = files.withColumn("stem", stem).withColumn("kind", kind)
    audio = f.where(F.col("kind").isin("wav", "mp3")).groupBy("stem").agg(F.min_by("name", F.when(F.col("kind") == "wav", 0).otherwise(1)).alias("audio"))
    return f.where("kind = 'srt'").select("stem", F.col("name").alias("srt")).join(audio, "stem", "full_outer")
