"""Mixing sources to target weights: whole copies by rate, and one seeded Bernoulli copy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, saved


@dataclass(frozen=True)
class Mixing:
    """weights: dealt to the sources by code point, null last, again and again.

    total: targets' sum over the sizes' sum; at most ``most``, the bound of target over size.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    total: float = 1.5
    most: float = 2.0
    seed: str = "mix"


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 of null."""
    # each run becomes one character: shorter than an array of the words
    runs = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """source, source_size, target of every source, from (source, size) rows.

    A target that would pass ``most`` times its size stops there and its excess goes to the others
    by weight: sources are filled in the order of limit over weight, which needs one pass. The
    table has a row a source, so its windows, which have no key, stay small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (nth % len(p.weights) + 1).cast("int"))
    limited = by_source.withColumn("w", weight).withColumn("lim", p.most * F.col("source_size"))
    order = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (p.total * F.sum("source_size").over(everything) - F.coalesce(F.sum("lim").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = limited.withColumn("level", level)
    # before the first source that isn't stopped all are stopped; it and the later ones share its level
    free = F.min(F.when(F.col("w") * F.col("level") <= F.col("lim"), F.struct(F.col("lim") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)
    share = F.when(F.col("w") * free["level"] < F.col("lim"), F.col("w") * free["level"]).otherwise(F.col("lim"))
    return filled.select("source", "source_size", F.coalesce(share, F.col("lim")).alias("target"))


def chance(p: Mixing, *by: Column) -> Column:
    """A number from 0 to 1 that the seed and ``by`` fix: 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(p.seed), *by)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_plan(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row, null texts having size 0.

    Sources without words have target 0. A null source is a source. Rows with one doc_id share
    their draw. An empty table gives no rows.
    """
    sizes = saved(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = saved(source_targets(sizes, p), "targets").withColumnRenamed("source", "s")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("s")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    one_more = chance(p, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) < rate - F.floor(rate)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor(rate) + one_more.cast("long")).alias("copies"))


def mixed(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sized = docs.withColumn("__size", word_count())
    targets = saved(source_targets(sized.select("source", F.col("__size").alias("size")), p), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("source").alias("__source"), rate.alias("__rate"))
    taken = docs.join(rates, docs["source"].eqNullSafe(rates["__source"]), "left")
    one_more = chance(p, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) < F.col("__rate") - F.floor("__rate")
    copies = (F.floor("__rate") + one_more.cast("long")).cast("int")
    return taken.withColumn("__nth", F.explode(F.array_repeat(F.lit(0), copies))).select(*columns_of(docs))
