"""JSON artefacts that hold a bare list or a list under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,start:double,end:double,confidence:double,speaker_id:string>"
REGION = "struct<start:double,end:double,confidence:double>"
FORCED = "struct<cue_id:int,start:double,end:double,score:double>"


def read_listed(spark: SparkSession, path: str, key: str, item: str, bare: bool = True) -> DataFrame:
    """Rows of every file, its stem being the episode; a file of neither shape fails."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("ep"), "value")
    return listed(files, key, item, bare)


def listed(files: DataFrame, key: str, item: str, bare: bool = True) -> DataFrame:
    """The items of (ep, value) JSON texts with their place."""
    under = F.from_json("value", f"struct<{key}:array<{item}>>")[key]
    plain = F.from_json("value", f"array<{item}>") if bare else F.lit(None)
    items = F.when(F.ltrim("value").startswith("["), plain).otherwise(under)
    checked = F.when(items.isNull(), F.raise_error(F.concat(F.lit(f"no list of {key} in "), "ep"))).otherwise(items)
    return files.select("ep", F.posexplode(checked).alias("idx", "x")).select("ep", F.col("idx").cast("long").alias("idx"), "x.*")


def words(spark: SparkSession, path: str) -> DataFrame:
    return read_listed(spark, path, "words", WORD).fillna({"confidence": 1.0})


def speech_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_listed(spark, path, "regions", REGION)


def overlap_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_listed(spark, path, "regions", REGION, bare=False)


def forced_cues(spark: SparkSession, path: str) -> DataFrame:
    return read_listed(spark, path, "cues", FORCED).fillna({"score": 1.0})
