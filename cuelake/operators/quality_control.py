"""Lint, style, evaluation, costs and the report's roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import aligned, cps
from .apply_decisions import plain_text
from .sequence import by

# The frame rates that detection tries, in order of preference.
FRAME_RATES = (23.976, 24.0, 25.0, 29.97, 30.0)


def cps_lint(cues: DataFrame, width: Column, most: float = 30.0, least: float = 2.0) -> DataFrame:
    """Reading speed, and whether it is impossible: too fast, or slow over more than 2 s."""
    lasts = F.col("end_ms") - F.col("start_ms")
    d = cues.withColumn("cps", cps(width, lasts))
    kind = F.when(F.col("cps") > most, "impossible_cps_fast").when((lasts > 2000) & (F.col("cps") < least), "impossible_cps_slow")
    return d.select("ep", "cue_id", "cps", kind.alias("kind"))


def style_lint(cues: DataFrame, width: Callable[[Column], Column], fps: float = 30.0, chars: int = 400, min_ms: int = 700, most_lines: int = 2) -> DataFrame:
    """A row for each rule that a cue breaks, of ``line_length`` one for each line over ``chars`` wide."""
    lasts = F.col("end_ms") - F.col("start_ms")
    w = by("pos")
    prev_end, prev = F.lag("end_ms").over(w), F.lag("speaker").over(w)
    same = prev.isNull() | F.col("speaker").isNull() | (prev == F.col("speaker"))
    lines = F.split("text", "\n")
    broken = {
        "negative_duration": (lasts < 0, "error"),
        "min_duration": (lasts < min_ms, "warning"),
        "frame_grid": (~aligned(F.col("start_ms"), fps) | ~aligned(F.col("end_ms"), fps), "warning"),
        "line_count": (F.size(lines) > most_lines, "warning"),
        "overlap": (F.coalesce((F.col("start_ms") < prev_end) & same, F.lit(False)), "warning"),
    }
    finding = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    found = F.filter(F.array(*(F.when(c, finding(k, s)) for k, (c, s) in broken.items())), lambda x: x.isNotNull())
    long = F.transform(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: width(x) > chars), lambda _: finding("line_length", "warning"))
    found = F.concat(found, long)
    return cues.withColumn("found", found).select("ep", "cue_id", "start_ms", F.explode("found").alias("x")).select("ep", "cue_id", "start_ms", "x.kind", "x.severity")


def qc_summary(flags: DataFrame) -> DataFrame:
    """Findings per episode by severity, all severities being there."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    return flags.groupBy("ep").agg(F.count("*").alias("total"), n("error"), n("warning"), n("info"), F.countDistinct("cue_id").alias("cues"))


def qc_rollup(flags: DataFrame) -> DataFrame:
    """A13 over kind within severity with subtotals; a null kind or severity is a total."""
    return flags.rollup("severity", "kind").agg(F.count("*").alias("n"))


def fps_detect(cues: DataFrame) -> DataFrame:
    """The frame rate whose grid the times miss least, if by 2 ms at most and clearly."""
    times = cues.select("ep", F.explode(F.array("start_ms", "end_ms")).alias("t"))
    rates = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("fps")) for i, f in enumerate(FRAME_RATES)))
    tried = times.select("ep", "t", F.explode(rates).alias("r")).select("ep", "t", "r.*")
    miss = F.abs(F.col("t") - F.bround(F.bround(F.col("t") / (1000.0 / F.col("fps"))) * (1000.0 / F.col("fps"))))
    errors = tried.groupBy("ep", "i", "fps").agg(F.round(F.avg(miss), 6).alias("error"))
    w = Window.partitionBy("ep").orderBy("error", "i")
    top = errors.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("error").over(w)).where("rank = 1")
    return top.select("ep", "fps", F.col("error").alias("error_ms"), ((F.col("error") <= 2) & (F.col("next") - F.col("error") >= 0.25)).alias("confident"))


def _limit(values: DataFrame, name: str, upper: bool) -> DataFrame:
    """ep and its highest or lowest value ``v``: from 20 values on without the outer twentieth."""
    n, i = F.count("*").over(Window.partitionBy("ep")), F.row_number().over(Window.partitionBy("ep").orderBy("v"))
    d = values.withColumn("n", n).withColumn("i", i)
    many = F.col("n") >= 20
    if upper:
        return d.where(F.col("i") <= F.when(many, F.greatest(F.lit(1), F.ceil(0.95 * F.col("n")))).otherwise(F.col("n"))).groupBy("ep").agg(F.max("v").alias(name))
    return d.where(F.col("i") > F.when(many, F.floor(0.05 * F.col("n"))).otherwise(0)).groupBy("ep").agg(F.min("v").alias(name))


def style_profile(cues: DataFrame, width: Callable[[Column], Column]) -> DataFrame:
    """A10: limits that an episode keeps: robust from 20 cues (or lines) on, else its extremes."""
    lasts = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    lines = F.split("text", "\n")
    d = cues.withColumn("d", lasts).withColumn("zero", F.col("end_ms") == F.lead("start_ms").over(by("pos")))
    whole = d.groupBy("ep").agg(F.count("*").alias("n"), F.coalesce(F.max("zero"), F.lit(False)).alias("zero_gap"), F.round(F.min("d"), 3).alias("shortest"), F.round(F.max("d"), 3).alias("longest"))
    many = _limit(cues.select("ep", F.size(lines).alias("v")), "lines", True)
    wide = _limit(cues.select("ep", F.explode(lines).alias("line")).select("ep", width(F.col("line")).alias("v")), "wide", True)
    short = _limit(d.select("ep", F.col("d").alias("v")), "short", False)
    out = whole.join(many, "ep").join(wide, "ep").join(short, "ep")
    return out.select("ep", "n", F.greatest(F.lit(2), "lines").cast("long").alias("max_lines"), F.greatest(F.lit(26), "wide").cast("long").alias("max_chars"), F.least(F.round("short", 3), F.lit(0.5)).alias("min_dur"), "zero_gap", "shortest", "longest")


def sample_style(cues: DataFrame, width: Callable[[Column], Column]) -> DataFrame:
    """Generation limits from an example's extremes, each held within bounds; cues of no length or text are not usable."""
    hold = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    lasts, plain = (F.col("end_ms") - F.col("start_ms")) / 1000.0, width(plain_text(F.col("text")))
    widest = F.array_max(F.transform(F.split("text", "\n"), width))
    d = cues.select("ep", lasts.alias("d"), (plain / lasts).alias("cps"), F.size(F.split("text", "\n")).alias("lines"), widest.alias("wide"), ((lasts > 0) & (plain > 0)).alias("usable"))
    return d.groupBy("ep").agg(
        F.bool_and("usable").alias("usable"), hold(F.max("lines"), 1, 4).cast("long").alias("max_lines"), hold(F.max("wide"), 10, 80).cast("long").alias("max_chars"),
        F.round(hold(F.min("d"), 0.2, 5.0), 3).alias("min_dur"), F.round(hold(F.max("d"), 0.5, 20.0), 3).alias("max_dur"), F.round(hold(F.min("cps"), 0.0, 10.0), 2).alias("min_cps"), F.round(hold(F.max("cps"), 5.0, 60.0), 2).alias("max_cps"),
    )


def cost_totals(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Items (ep, kind, tokens_in, tokens_out) by a price list in billionths of a dollar.

    Each item is rounded to a millionth, half up, in whole numbers; the total is exact.
    """
    nano = F.col("tokens_in") * F.coalesce("nano_in", F.lit(0)) + F.col("tokens_out") * F.coalesce("nano_out", F.lit(0))
    priced = items.join(prices, "kind", "left").withColumn("micro", F.floor((nano + 500) / 1000))
    return priced.groupBy("ep").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("micro") / 1e6).alias("usd"))


def audio_cost(audio: DataFrame, per_hour: float) -> DataFrame:
    """Dollars of (ep, seconds) at a price an hour, to a millionth each."""
    return audio.groupBy("ep").agg(F.sum(F.round(F.col("seconds") / 3600.0 * per_hour, 6)).alias("usd"))


# Names under which providers report tokens read and written.
TOKENS_IN = ("input_tokens", "prompt_tokens", "prompt_token_count")
TOKENS_OUT = ("output_tokens", "completion_tokens", "candidates_token_count")


def usage(response: Column) -> tuple[Column, Column]:
    """(tokens read, tokens written) of a response's JSON, under ``usage`` or ``usage_metadata``; 0 where neither says."""
    get = lambda names: F.coalesce(*(F.get_json_object(response, f"$.{where}.{n}").try_cast("long") for where in ("usage", "usage_metadata") for n in names), F.lit(0))
    return get(TOKENS_IN), get(TOKENS_OUT)
