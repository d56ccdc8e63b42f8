"""Fixtures, stage tables, caches, configuration and reports: what a run reads besides its input and what it leaves."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .json_tables import read_listed
from .srt import block

DECISION = "struct<case_id:string,verdict:string,final_text:string,confidence:double,speaker:string,character:string,reason:string>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("ep"), "value")


def mapped(files: DataFrame, key: str, value: str) -> DataFrame:
    """(ep, key, value) of (ep, value) JSON objects; text that is none fails and names its episode."""
    m = F.from_json("value", "map<string,string>")
    checked = F.when(m.isNull(), F.raise_error(F.concat(F.lit("no JSON object in "), "ep"))).otherwise(m)
    return files.select("ep", F.explode(checked).alias(key, value))


def speaker_map(spark: SparkSession, path: str, cues: DataFrame) -> DataFrame:
    """(ep, speaker, character) of the speakers that the cues have."""
    named = mapped(_files(spark, path), "speaker", "character")
    return named.join(cues.select(F.col("ep").cast("string").alias("ep"), "speaker").distinct(), ["ep", "speaker"], "left_semi")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions in order (ep, idx, case_id, verdict, final_text, confidence, ...) of files with a list, bare or under ``decisions``."""
    return read_listed(spark, path, "decisions", DECISION)


def punctuation(spark: SparkSession, path: str) -> DataFrame:
    """(ep, cue_id, proposed) of files that map cue ids to texts; keys that are no numbers have a null cue."""
    return mapped(_files(spark, path), "cue", "proposed").select("ep", F.col("cue").try_cast("long").alias("cue_id"), "proposed")


# ---- stages and caches


def write_stage(df: DataFrame, root: str, name: str) -> None:
    """K4: a stage's table, replaced as a whole."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of an earlier stage; a run that lacks it is told which stage to repeat."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"stage {name} has left nothing in {root}: run it again")
    return spark.read.parquet(f"{root}/{name}")


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with the cached value, requests without one), by digest."""
    return requests.join(cache.select("digest", "value"), "digest"), requests.join(cache.select("digest"), "digest", "left_anti")


def merged_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """K5: the cache with fresh values in place of old ones; of several fresh ones for a digest the greatest."""
    new = fresh.groupBy("digest").agg(F.max("value").alias("value"))
    return cache.select("digest", "value").join(new, "digest", "left_anti").unionByName(new)


# ---- configuration


def read_config(path: str, text: str | None = None) -> dict:
    """A YAML mapping; errors name the file. An empty file is an empty mapping."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    if text is None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    try:
        out = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is no YAML: {e}") from e
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError(f"{path} must hold a mapping")
    return out


def config_text(values: dict) -> str:
    """K6: YAML without what is not set."""
    import yaml

    return yaml.safe_dump({k: v for k, v in values.items() if v is not None}, sort_keys=False, allow_unicode=True)


def without_secrets(params: Column, names: tuple[str, ...]) -> Column:
    """A map of parameters without those of secret names, whatever their case."""
    return F.map_filter(params, lambda k, _: ~F.lower(k).isin(*names))


# ---- reports


def report(cues: DataFrame, flags: DataFrame, issues: DataFrame, scores: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """K2: ep, json, html: a report an episode. Flags come in their ``rank``; issues by severity.

    flags: ep, rank, severity, kind, cue_ids, message, old_text, new_text. issues: ep, cue_id, severity,
    kind. scores: ep, cue_id, cps, score, source.
    """

    def listed(d: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
        item = F.struct(*fields)
        rows = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), item.alias("item")))), lambda x: x["item"])
        return d.groupBy("ep").agg(rows.alias(name))

    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(9)
    d = cues.groupBy("ep").agg(F.count("*").alias("cue_count"))
    d = d.join(listed(scores, "cue_scores", ["cue_id"], ["cue_id", "cps", "score", "source"]), "ep", "left")
    d = d.join(listed(flags, "flags", ["rank"], ["severity", "kind", "cue_ids", "message", "old_text", "new_text"]), "ep", "left")
    d = d.join(listed(issues.withColumn("level", level), "style_issues", ["level", "cue_id", "kind"], ["severity", "kind", "cue_id"]), "ep", "left")
    n = lambda c, s: F.size(F.filter(F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)), lambda x: x["severity"] == s))
    both = lambda s: (n("flags", s) + n("style_issues", s)).alias(f"{s}_count")
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    extra = [F.lit(v).alias(k) for k, v in (metadata or {}).items()]
    d = d.withColumn("summary", F.struct(*extra, "cue_count", size("flags").alias("flags"), size("style_issues").alias("style_violations"), both("error"), both("warning"), both("info")))
    json = F.to_json(F.struct("summary", "cue_scores", "flags", "style_issues"))

    def rows(c: str, fields: tuple[str, ...]) -> Column:
        cell = lambda x, f: F.concat(F.lit("<td>"), F.replace(html_escape(F.coalesce(x[f].cast("string"), F.lit(""))), F.lit("\n"), F.lit("<br>")), F.lit("</td>"))
        return F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)), lambda x: F.concat(F.lit("<tr>"), *(cell(x, f) for f in fields), F.lit("</tr>"))), "")

    def part(title: str, c: str, fields: tuple[str, ...]) -> list[Column]:
        head = "".join(f"<th>{f}</th>" for f in fields)
        return [F.lit(f"<h2>{title}</h2><table><tr>{head}</tr>"), rows(c, fields), F.lit("</table>")]

    page = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>Report</title></head><body><pre>'), html_escape(F.to_json("summary")), F.lit("</pre>"),
        *part("Scores", "cue_scores", ("cue_id", "cps", "score", "source")), *part("Findings", "flags", ("severity", "kind", "cue_ids", "message", "old_text", "new_text")),
        *part("Style", "style_issues", ("severity", "kind", "cue_id")), F.lit("</body></html>"),
    )
    return d.select("ep", json.alias("json"), page.alias("html"))


def changes_srt(flags: DataFrame) -> DataFrame:
    """K3: ep, srt: the findings (ep, nth, kind, cue_ids, old_text, new_text, start, end in seconds) with texts, as SRT blocks."""
    ms = lambda c: F.greatest(F.lit(0), F.round(F.coalesce(c, F.lit(0.0)) * 1000)).cast("long")
    lines = lambda c, sign: F.when(c.isNotNull(), F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), x)), "\n"))
    ids = F.array_join(F.coalesce("cue_ids", F.array().cast("array<long>")).cast("array<string>"), ", ")
    head = F.concat(F.lit("# "), "kind", F.lit(" cue="), F.when(ids == "", "ad-lib").otherwise(ids))
    d = flags.where("old_text is not null or new_text is not null").withColumn("a", ms(F.col("start")))
    d = d.withColumn("b", F.greatest("a", ms(F.col("end")))).withColumn("text", F.concat_ws("\n", head, lines(F.col("old_text"), "- "), lines(F.col("new_text"), "+ ")))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("ep").orderBy("a", "b", "nth")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", block(F.col("n"), F.col("a"), F.col("b"), F.col("text")).alias("x")))), lambda x: x["x"])
    return d.groupBy("ep").agg(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")).alias("srt"))


# ---- uploads


def scan_bytes(files: DataFrame, max_lines: int, max_line_bytes: int) -> DataFrame:
    """Ep, problem of (ep, content) before anything is parsed: too many lines, or one too long, in bytes.

    Lines end with CR, LF or both. Bytes are looked at as they are, so broken text is counted too.
    """
    lines = F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n"), "\n")
    n = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    long = F.array_position(F.transform(lines, lambda x: F.length(x) > max_line_bytes), True)
    problem = F.when(n > max_lines, F.format_string("more than %d lines", F.lit(max_lines))).when(long > 0, F.format_string("line %d is longer than %d bytes", long, F.lit(max_line_bytes)))
    return files.select("ep", problem.alias("problem"))


def nfkc(text: Column) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(text)


# Signs and names that a file on Windows cannot have.
UNSAFE = r'[<>:"/\\|?*]'
RESERVED = ("con", "prn", "aux", "nul", *(f"{x}{n}" for x in ("com", "lpt") for n in range(1, 10)))


def safe_name(name: Column, folded: Column, suffix: str = "-synced.srt", most: int = 255) -> Column:
    """P20: whether a file name (and ``folded``, its NFKC form) may be stored: signs, reserved names, length in UTF-16."""
    units = lambda c: F.length(F.encode(c, "UTF-16BE")) / 2
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folded_stem = F.regexp_replace(folded, r"\.[^.]*$", "")
    hidden = folded.rlike(r"(?i)%(?:[01][0-9a-f]|7f|22|2a|2f|3a|3c|3e|3f|5c|7c)")
    bad = (name == "") | (units(folded) > most) | folded.isin(".", "..") | folded.rlike(UNSAFE) | folded.rlike(r"\p{C}") | hidden
    bad_stem = (F.regexp_replace(folded_stem, r"[ .]", "") == "") | folded_stem.rlike(r"[ .]$") | F.lower(folded_stem).isin(*RESERVED) | (units(F.concat(stem, F.lit(suffix))) > most)
    return F.coalesce(~bad & ~bad_stem, F.lit(False))


def upload_plan(files: DataFrame, most: int = 10) -> DataFrame:
    """Batch, key, audio, srt, problem of uploads (batch, name): pairs by name without ending, NFKC and upper case.

    A problem is the batch's: no audio or over ``most``, an unsafe name, a name twice, or subtitles that
    are neither absent nor one for each audio file.
    """
    f = files.withColumn("folded", nfkc(F.col("name"))).withColumn("kind", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    f = f.withColumn("key", F.upper(F.regexp_replace("folded", r"\.[^.]*$", ""))).withColumn("safe", safe_name(F.col("name"), F.col("folded")))
    audio, srt = F.col("kind").isin("wav", "mp3"), F.col("kind") == "srt"
    pairs = f.groupBy("batch", "key").agg(F.max(F.when(audio, F.col("name"))).alias("audio"), F.max(F.when(srt, F.col("name"))).alias("srt"), F.count(F.when(audio, 1)).alias("na"), F.count(F.when(srt, 1)).alias("ns"), F.bool_and("safe").alias("safe"))
    w = Window.partitionBy("batch")
    n, m = F.sum("na").over(w), F.sum("ns").over(w)
    problem = (
        F.when((n < 1) | (n > most), f"between 1 and {most} audio files are taken").when(~F.bool_and("safe").over(w), "a name cannot be stored")
        .when((F.max("na").over(w) > 1) | (F.max("ns").over(w) > 1), "names must differ").when((m > 0) & F.max((F.col("na") != F.col("ns"))).over(w), "every audio file needs its subtitle")
    )
    return pairs.withColumn("problem", problem).select("batch", "key", "audio", "srt", "problem")


def predicted_bytes(seconds: Column) -> Column:
    """Bytes that audio takes at 16 kHz, mono, 16 bits, with a MiB to spare."""
    return (F.ceil(seconds * 32_000) + 1024 * 1024).cast("long")


def processed(files: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Files through an outside program, batch by batch, ``process`` returning what it says of each."""

    def run(batches):
        for pdf in batches:
            yield process(pdf)

    return files.mapInPandas(run, schema)
