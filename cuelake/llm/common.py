"""Shared helpers: intermediate tables in the cluster's shared folder, folds, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_TABLES: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local session takes a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. They go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWN_TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OWN_TABLES:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def columns_of(df: DataFrame) -> list:
    """All columns, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5; 0 marks the held-out fifth."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round takes the least label among a node's neighbours (a partial aggregate, so a hub is
    no hot task) and then jumps to the label's own label. A path of n nodes needs O(log n) rounds.
    Only a count of changes reaches the driver. Null endpoints and self-loops add no link.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = saved(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        )
        hooked = labels.join(near, "u").select("u", F.least("c", "m").alias("n"), F.col("c").alias("was"))
        hooked = saved(hooked, "hooked")
        jump = hooked.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        new = saved(
            hooked.join(jump, "n").select("u", F.least("n", "nn").alias("c"), "was"), "labels"
        )
        changed = new.where("c < was").limit(1).count()
        forget(hooked)
        forget(labels)
        labels = new.select("u", "c")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
