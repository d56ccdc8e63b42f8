"""The engine's tables as views over the driver's Parquet tables (integer arithmetic only).

cues: ep, pos, cue_id, start_ms, end_ms, text, speaker. words: ep, word_idx, start_us, end_us, text,
confidence, speaker. regions: ep, start_us, end_us.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("ep").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ep"), F.col("turn").alias("pos"), (F.col("turn") + 1).alias("cue_id"), "text", F.col("role").alias("speaker"))
    c = c.withColumn("dur", 500 + (F.length("text") % 97) * 40).withColumn("gap", ((F.col("ep") * 7 + F.col("pos") * 13) % 9 - 2) * 300)
    start = 1000 + F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return c.withColumn("start_ms", start.cast("long")).withColumn("end_ms", (F.col("start_ms") + F.col("dur")).cast("long")).drop("dur", "gap")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = ((F.col("ep") * 31 + F.col("pos") * 17) % 7 - 3) * 20
    return cues(spark, sf_dir).withColumn("start_ms", F.col("start_ms") + shift).withColumn("end_ms", F.col("end_ms") + shift)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("ep").orderBy("ts", "event_id")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    w = read(spark, sf_dir, "events").select(F.col("user_id").alias("ep"), "ts", "event_id", us.alias("start_us"), F.floor(F.col("value") * 100).cast("long").alias("dur"), F.col("event_type").alias("text"), ((F.col("event_id") % 101) / 100).alias("confidence"), (F.col("event_id") % 3).alias("speaker"))
    return w.withColumn("word_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("end_us", F.col("start_us") + F.col("dur") * 1_000_000).drop("ts", "dur")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where("text = 'purchase'").select("ep", "start_us", "end_us", F.col("word_idx").alias("region_idx"))


#: The same views for DuckDB.
ORACLE_VIEWS = """
WITH v_cues AS (
  SELECT ep, pos, cue_id, text, speaker, start_ms, start_ms + dur AS end_ms FROM (
    SELECT *, (1000 + coalesce(sum(dur + gap) OVER (PARTITION BY ep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms FROM (
      SELECT conv_id AS ep, turn AS pos, turn + 1 AS cue_id, text, role AS speaker, 500 + (length(text) % 97) * 40 AS dur, ((conv_id * 7 + turn * 13) % 9 - 2) * 300 AS gap FROM conversations))),
v_golden AS (SELECT ep, pos, cue_id, text, speaker, start_ms + ((ep * 31 + pos * 17) % 7 - 3) * 20 AS start_ms, end_ms + ((ep * 31 + pos * 17) % 7 - 3) * 20 AS end_ms FROM v_cues),
v_words AS (
  SELECT user_id AS ep, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS start_us, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) + floor(value * 100)::BIGINT * 1000000 AS end_us,
    event_type AS text, (event_id % 101) / 100 AS confidence, event_id % 3 AS speaker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS word_idx FROM events),
v_regions AS (SELECT ep, start_us, end_us, word_idx AS region_idx FROM v_words WHERE text = 'purchase')
"""
