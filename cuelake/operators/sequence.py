"""Window operators over an episode's cues or words; every one is a plan of built-in functions.

Inputs carry ``ep`` and an order; nothing crosses an episode, so each operator is one exchange by
episode at most and several share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import snap_ceil, snap_floor


def together(df: DataFrame, key: str = "ep") -> DataFrame:
    """Rows of one ``key`` in one partition, for passes over whole partitions.

    Dealt by the key's hash: an exchange by the key itself is left out where the rows seem to lie so
    already, and what they lie in (a union's sides, joins) can be read in other partitions in the end.
    """
    return df.repartition(F.xxhash64(key))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals out both sides.

    What explodes from a small table is guessed as small as that; it would be gathered whole by the driver.
    """
    return df.hint("merge")


def by(*order: str, part: tuple[str, ...] = ("ep",)):
    return Window.partitionBy(*part).orderBy(*order)


def islands(df: DataFrame, new: Column, order: list[str], name: str = "island", part: tuple[str, ...] = ("ep",)) -> DataFrame:
    """Numbers runs of rows; a row where ``new`` is true or null begins one."""
    w = by(*order, part=part)
    flagged = df.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int"))
    return flagged.withColumn(name, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("__new")


def before(c: str, order: list[str] = ["pos"], part: tuple[str, ...] = ("ep",)) -> Column:
    return F.lag(c).over(by(*order, part=part))


def after(c: str, order: list[str] = ["pos"], part: tuple[str, ...] = ("ep",)) -> Column:
    return F.lead(c).over(by(*order, part=part))


def chronological(cues: DataFrame, given: str = "given") -> DataFrame:
    """Place by (start, given order), and whether the row moved."""
    at = (F.row_number().over(by(given)) - 1).cast("long")
    to = (F.row_number().over(by("start_ms", given)) - 1).cast("long")
    return cues.withColumn("from_pos", at).withColumn("to_pos", to).withColumn("moved", F.col("from_pos") != F.col("to_pos"))


def scene_batches(cues: DataFrame, gap_ms: int = 1200) -> DataFrame:
    """A batch ends where the next cue starts more than ``gap_ms`` after it; unknown times join."""
    new = F.when(before("cue_id").isNull(), True).otherwise(F.coalesce(F.col("start_ms") - before("end_ms") > gap_ms, F.lit(False)))
    return islands(cues, new, ["pos"], "batch")


def overlap_flags(cues: DataFrame) -> DataFrame:
    """Cues that start before their predecessor ends."""
    d = cues.withColumn("prev_id", before("cue_id")).withColumn("prev_end", before("end_ms"))
    return d.where(F.col("start_ms") < F.col("prev_end")).select("ep", F.col("prev_id").alias("left_id"), F.col("cue_id").alias("right_id"), (F.col("prev_end") - F.col("start_ms")).alias("overlap_ms"))


def order_inversions(cues: DataFrame, given: str = "given") -> DataFrame:
    """Adjacent cues of the given order whose starts fall."""
    d = cues.withColumn("prev_id", before("cue_id", [given])).withColumn("prev_start", before("start_ms", [given]))
    return d.where(F.col("start_ms") < F.col("prev_start")).select("ep", F.col("prev_id").alias("left_id"), F.col("cue_id").alias("right_id"))


def match_runs(ops: DataFrame, matched: Column, least: int = 3) -> DataFrame:
    """Runs of consecutive matches of ``least`` or more: bounds, length and mean confidence."""
    d = ops.withColumn("m", matched)
    runs = islands(d, F.col("m") != F.lag("m").over(by("word_idx")), ["word_idx"], "run").where("m")
    rolled = runs.groupBy("ep", "run").agg(F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.round(F.avg("confidence"), 4).alias("score"))
    return rolled.where(F.col("n") >= least)


def sessionize(words: DataFrame, gap_us: int, by_speaker: bool = True) -> DataFrame:
    """W16 by gap and speaker: a word opens a group after a longer gap or on another speaker."""
    order = ["word_idx"]
    gap = F.col("start_us") - before("end_us", order) > gap_us
    other = F.coalesce(F.col("speaker") != before("speaker", order), F.lit(False)) if by_speaker else F.lit(False)
    grouped = islands(words, gap | other, order, "grp")
    return grouped.groupBy("ep", "grp").agg(F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def dominant_speaker(words: DataFrame) -> DataFrame:
    """A2: the most frequent speaker, the first seen among equals; nulls do not count."""
    counted = words.where("speaker is not null").groupBy("ep", "speaker").agg(F.count("*").alias("n"), F.min("word_idx").alias("first"))
    return counted.groupBy("ep").agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("speaker"), F.max("n").alias("n"))


def dense_cluster(words: DataFrame, gap_us: int, long_us: int, key: tuple[str, ...] = ("ep", "cue_id")) -> DataFrame:
    """Each cue's largest cluster of words: by normal words, words, then the shorter, then the first.

    A gap over ``gap_us`` splits, and a word over ``long_us`` stands alone.
    """
    order = ["start_us", "word_idx"]
    w = by(*order, part=key)
    d = words.withColumn("lasts", F.col("end_us") - F.col("start_us"))
    new = (F.col("start_us") - F.lag("end_us").over(w) > gap_us) | (F.lag("lasts").over(w) > long_us) | (F.col("lasts") > long_us)
    split = islands(d, new, order, "part", key)
    rolled = split.groupBy(*key, "part").agg(F.sum((F.col("lasts") <= long_us).cast("long")).alias("normal"), F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    best = Window.partitionBy(*key).orderBy(F.desc("normal"), F.desc("n"), (F.col("end_us") - F.col("start_us")), "part")
    return rolled.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def interpolate(cues: DataFrame, matched: Column, fps: float = 30.0, min_ms: int = 500, most_ms: int = 2000) -> DataFrame:
    """Untimed cues from their timed neighbours, on frames.

    ``src_start_ms`` and ``src_end_ms`` are the source's times, those of the cue where they are not there.
    Between two timed cues a cue stands at the same share of the gap as in the source, and ends by the
    next one; after or before the only one it keeps the source's gap. It lasts as long as in the source,
    from ``min_ms`` to ``most_ms``. Without any timed cue it stays.
    """
    src = [F.col(c) if c in cues.columns else F.col(c.removeprefix("src_")) for c in ("src_start_ms", "src_end_ms")]
    t = cues.withColumn("timed", matched).withColumn("__s", src[0]).withColumn("__e", src[1])
    past, future = by("pos").rowsBetween(Window.unboundedPreceding, -1), by("pos").rowsBetween(1, Window.unboundedFollowing)
    anchor = F.when(F.col("timed"), F.struct("start_ms", "end_ms", "__s", "__e"))
    t = t.withColumn("p", F.last(anchor, ignorenulls=True).over(past)).withColumn("n", F.first(anchor, ignorenulls=True).over(future))
    floor, ceil = (lambda c: snap_floor(c, fps)), (lambda c: snap_ceil(c, fps))
    t = t.withColumn("lasts", F.greatest(ceil(F.lit(min_ms)), F.least(F.col("__e") - F.col("__s"), F.lit(most_ms))))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__s") - F.col("p.__e")) / F.greatest(F.lit(1), F.col("n.__s") - F.col("p.__e"))))
    between = floor(F.col("p.end_ms") + share * F.greatest(F.lit(0), F.col("n.start_ms") - F.col("p.end_ms")))
    gap = F.greatest(F.lit(0), F.col("n.__s") - F.col("__e"))
    kept = F.least(F.col("n.start_ms"), ceil(F.col("n.start_ms") - gap))
    before_next = F.when(kept >= F.col("lasts"), kept).otherwise(F.col("n.start_ms"))
    both, after_p, before_n = F.col("p").isNotNull() & F.col("n").isNotNull(), F.col("p").isNotNull(), F.col("n").isNotNull()
    t = t.withColumn("a", F.when(both, between).when(after_p, floor(F.col("p.end_ms") + F.greatest(F.lit(0), F.col("__s") - F.col("p.__e")))).when(before_n, F.greatest(F.lit(0), floor(before_next - F.col("lasts")))))
    t = t.withColumn("z", F.when(both, F.least(F.col("n.start_ms"), ceil(F.col("a") + F.col("lasts")))).when(after_p, ceil(F.col("a") + F.col("lasts"))).when(before_n, before_next))
    # no room between both: before the next one, or as short as may be
    none = both & (F.col("z") <= F.col("a"))
    t = t.withColumn("a", F.when(none, F.greatest(F.col("p.end_ms"), floor(F.col("n.start_ms") - F.col("lasts")))).otherwise(F.col("a")))
    t = t.withColumn("z", F.when(none, F.greatest(F.col("n.start_ms"), ceil(F.col("a") + min_ms))).otherwise(F.col("z")))
    pick = lambda own, new: F.when(F.col("timed"), F.col(own)).otherwise(F.coalesce(new, own)).cast("long")
    return t.select(*cues.columns, "timed", pick("start_ms", "a").alias("new_start"), pick("end_ms", "z").alias("new_end"))


def next_same_speaker(cues: DataFrame) -> DataFrame:
    """The start of the same speaker's next cue; cues without speaker follow one another."""
    keyed = cues.withColumn("__s", F.coalesce(F.col("speaker"), F.lit("__unknown__")))
    return keyed.withColumn("next_start", F.lead("start_ms").over(by("pos", part=("ep", "__s")))).drop("__s")


def extend_into_gap(cues: DataFrame, min_ms: int, fps: float, zero_gap: bool = True) -> DataFrame:
    """Short cues last ``min_ms`` on the frame grid, but not into the same speaker's next cue.

    A cue that reaches past that one's start already is lengthened without regard to it.
    """
    least, limit = F.col("least_end"), F.col("next_start") if zero_gap else snap_floor(F.greatest(F.lit(0), F.col("next_start") - 1), fps)
    d = next_same_speaker(cues).withColumn("least_end", snap_ceil(F.col("start_ms") + min_ms, fps))
    free = F.col("next_start").isNull() | (F.col("end_ms") > F.col("next_start"))
    end = F.when(F.col("end_ms") >= least, F.col("end_ms")).when(free, least).otherwise(F.least(least, F.greatest("end_ms", limit)))
    return d.withColumn("new_end", end.cast("long")).drop("least_end")


def cap_overlaps(cues: DataFrame, fps: float) -> DataFrame:
    """A cue that passes the next one's start ends there, a millisecond after its own start at least.

    Ends after the start are then put on the frame grid, which may bring them back to the start.
    """
    nxt = after("start_ms")
    end = F.when(F.coalesce(F.col("end_ms") > nxt, F.lit(False)), F.greatest(F.col("start_ms") + 1, nxt)).otherwise(F.col("end_ms"))
    d = cues.withColumn("__end", end)
    return d.withColumn("new_end", F.when(F.col("__end") > F.col("start_ms"), snap_floor(F.col("__end"), fps)).otherwise(F.col("__end")).cast("long")).drop("__end")


def cps_extend(cues: DataFrame, width: Column, most: float, fps: float, most_ms: int = 7000) -> DataFrame:
    """A cue read faster than ``most`` lasts longer if all it needs fits before the next one."""
    need = snap_ceil(F.col("start_ms") + F.ceil(width / most * 1000), fps)
    need = F.least(need, F.greatest(F.col("start_ms") + 1, snap_floor(F.col("start_ms") + most_ms, fps)))
    fits = (need > F.col("end_ms")) & (F.coalesce(after("start_ms"), F.lit(2**62)) >= need)
    return cues.withColumn("new_end", F.when(fits & (width > 0), need).otherwise(F.col("end_ms")))


def duplicate_fragments(cues: DataFrame, toks: Column) -> DataFrame:
    """Runs of up to three cues whose last repeats a part of the one before; each run once.

    The last cue is the start or the end of the one before, or its first two tokens are that one's
    first two or last two. Both have two tokens or more. What moves is a cue's tokens, to the next cue.
    """
    d = cues.withColumn("t", toks).withColumn("pt", F.lag(toks).over(by("pos"))).withColumn("ids", F.array_compact(F.array(F.lag("cue_id", 2).over(by("pos")), before("cue_id"), F.col("cue_id"))))
    n, m = F.size("t"), F.size("pt")
    part = lambda c, at, k: F.slice(c, F.greatest(at, F.lit(1)), F.greatest(k, F.lit(1)))
    fits = n <= m
    kind = (
        F.when(fits & (F.col("t") == part("pt", F.lit(1), n)), "prefix")
        .when(fits & (F.col("t") == part("pt", m - n + 1, n)), "suffix")
        .when(F.slice("t", 1, 2) == F.slice("pt", 1, 2), "opening")
        .when(F.slice("t", 1, 2) == part("pt", m - 1, F.lit(2)), "ending")
    )
    found = d.where((n >= 2) & (m >= 2)).withColumn("kind", kind).where("kind is not null")
    return found.groupBy("ep", F.col("ids").alias("cue_ids")).agg(F.max_by("kind", "pos").alias("kind"))


def token_offsets(cues: DataFrame, toks: Column) -> DataFrame:
    """Number of tokens before each cue."""
    n = F.size(toks).cast("long")
    return cues.withColumn("n_tokens", n).withColumn("offset", F.coalesce(F.sum(n).over(by("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def even_parts(cues: DataFrame, k: Column) -> DataFrame:
    """Contiguous parts of an episode, sizes differing by one at most, larger ones first."""
    n, i = F.count("*").over(Window.partitionBy("ep")), F.row_number().over(by("pos")) - 1
    size, extra = F.floor(n / k), n % k
    part = F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return cues.withColumn("part", part.cast("long"))


def time_priors(cues: DataFrame, toks: Column) -> DataFrame:
    """Each token's expected time within its cue and the radius around it."""
    t = cues.select("ep", "cue_id", "start_ms", "end_ms", F.posexplode(toks).alias("i", "token"), F.size(toks).alias("n"))
    lasts = F.col("end_ms") - F.col("start_ms")
    return t.select("ep", "cue_id", F.col("i").cast("long").alias("token_idx"), "token", (F.col("start_ms") + lasts * (2 * F.col("i") + 1) / (2 * F.col("n"))).alias("expected_ms"), F.greatest(F.lit(2000), lasts).cast("long").alias("radius_ms"))


def flag_order(flags: DataFrame, cues: DataFrame) -> DataFrame:
    """Place of each finding (ep, nth, severity, start_ms, cue_ids) in its episode's report.

    Errors come first, then warnings and infos, others last; then by start, else by the first start of
    the finding's cues; then by the least cue id, then in the order given (``nth``).
    """
    first = flags.select("ep", "nth", F.explode("cue_ids").alias("cue_id")).join(cues.select("ep", "cue_id", F.col("start_ms").alias("at")), ["ep", "cue_id"]).groupBy("ep", "nth").agg(F.min("at").alias("__at"))
    d = flags.join(first, ["ep", "nth"], "left")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(9)
    w = Window.partitionBy("ep").orderBy(rank, F.coalesce("start_ms", "__at").asc_nulls_last(), F.array_min("cue_ids").asc_nulls_last(), "nth")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).drop("__at")
