"""Hard negatives by inverted lists of k-means clusters with stored radii.

Rows are dealt to the list of their label and nearest centroid; each row stores its distance from the
centroid and a list is cut into blocks of bounded size. By Cauchy and Schwarz the inner product of an
anchor a and any row of a block lies within <a, c> plus or minus |a| * radius, so the bounds tell before
a visit whether the block can hold a row that is asked for.

A search visits blocks in the order of the upper bound, skips those whose bounds lie outside its window
of scores, and stops when the bound falls strictly below its kth score. A task holds a block of anchors
and some blocks of rows and sends at most k rows a search; the best of these are the result, which is
exact whatever the centroids are. These are fitted on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class HardNegatives:
    """positives, negatives: how many of each. low, high: a negative's score in hundredths of its positive's.

    scale: components become floor(scale * x). sample: most rows that centroids are fitted on.
    rows_per_list: rows a list should have; most_lists: most centroids, whatever the table's size.
    block: rows a block (expected). anchors: anchors a task (expected). visit: blocks a task (expected).
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample: int = 16_384
    rows_per_list: int = 256
    most_lists: int = 256
    rounds: int = 8
    block: int = 2048
    anchors: int = 8192
    visit: int = 16
    seed: int = 13


def quantised(rows: DataFrame, p: HardNegatives = HardNegatives()) -> DataFrame:
    """row (a number of its own), vec_id, label, q (floors of ``scale`` times the components, as doubles), saved.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows that
    share a vec_id are rows of their own. Other columns are not read.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale).cast("double"))
    kept = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return saved(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("q")), "quantised")


def centroids(sample: np.ndarray, k: int, p: HardNegatives) -> np.ndarray:
    """k-means by Lloyd's rounds over the sample."""
    k = min(k, len(sample))
    rng = np.random.default_rng(p.seed)
    found = sample[np.sort(rng.choice(len(sample), k, replace=False))].copy()
    for _ in range(p.rounds):
        near = _nearest(sample, found)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def _nearest(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    half = (found * found).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ found.T - half, axis=1) for i in range(0, len(rows), 4096)])


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _dealer(found: dict[int, np.ndarray]):
    """Nearest centroid and the distance from it, for batches of (row, vec_id, label, q, dim)."""

    def deal(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cell, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows, middle = _matrix(batch.column("q").take(pa.array(at)), int(dim)), found.get(int(dim))
                if middle is None:  # a length that the sample missed: one list around the origin
                    middle = np.zeros((1, int(dim)))
                cell[at] = _nearest(rows, middle)
                far[at] = np.sqrt(((rows - middle[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return deal


def _fit(rows: DataFrame, p: HardNegatives) -> dict[int, np.ndarray]:
    """Centroids of each vector length, from at most ``sample`` rows (those of the least hashes of all)."""
    n, labels = rows.agg(F.count("*"), F.count_distinct("label")).first()
    if not n:
        return {}
    picked = rows.select("dim", "q", F.xxhash64("vec_id", F.lit(p.seed)).alias("h")).orderBy("h").limit(p.sample).toArrow()
    dims, out = np.asarray(picked.column("dim")), {}
    k = max(1, min(p.most_lists, n // (p.rows_per_list * labels)))
    for dim in np.unique(dims):
        out[int(dim)] = centroids(_matrix(picked.column("q").take(pa.array(np.flatnonzero(dims == dim))), int(dim)), k, p)
    return out


def _exact(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in doubles where these hold every sum exactly."""
    top = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(anchors.shape[1], 1)
    if top < 2**53:
        return anchors @ rows.T
    whole = [[int(x) for x in r] for r in anchors.tolist()], [[int(x) for x in r] for r in rows.tolist()]
    return np.array([[sum(x * y for x, y in zip(a, r)) for r in whole[1]] for a in whole[0]], object).reshape(len(anchors), len(rows))


class _Held:
    """The best k rows of each search so far: score, then smaller vec_id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.vec, self.row = np.zeros((2, n, k), np.int64)

    def add(self, who, score, vec, row) -> None:
        again = np.unique(who)
        x, y = np.nonzero(self.score[again] > -np.inf)
        x = again[x]
        who, score = np.concatenate([who, x]), np.concatenate([score, self.score[x, y]])
        vec, row = np.concatenate([vec, self.vec[x, y]]), np.concatenate([row, self.row[x, y]])
        by = np.lexsort((row, vec, -score, who))
        who = who[by]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        nth = np.arange(len(who)) - np.repeat(start, np.diff(start, append=len(who)))
        best = nth < self.k
        who, nth, by = who[best], nth[best], by[best]
        self.score[who, nth], self.vec[who, nth], self.row[who, nth] = score[by], vec[by], row[by]


def _visits(found: dict[int, np.ndarray], k: int, same_label: bool):
    """One task: anchors (side 0) with what they ask for, and the rows of some blocks (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        side, dim = table.column("side").to_numpy(), int(table.column("dim")[0].as_py())
        mine, theirs = (table.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1))
        asks = mine.column("asks").combine_chunks()
        owner = np.repeat(np.arange(len(mine)), np.asarray(asks.value_lengths()))
        search, lo, hi = (np.asarray(asks.flatten().field(c)) for c in ("search", "lo", "hi"))
        a, rows = _matrix(mine.column("q"), dim), _matrix(theirs.column("q"), dim)
        a_row, a_label = (mine.column(c).to_numpy() for c in ("row", "label"))
        row, label, vec, cell, far, block = (theirs.column(c).to_numpy() for c in ("row", "label", "vec_id", "cell", "far", "block"))
        norm, middles = np.sqrt((a * a).sum(axis=1)), found.get(dim, np.zeros((1, dim)))
        order = np.argsort(block, kind="stable")
        blocks = []
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
            near, reach = a @ middles[cell[at[0]]], norm * far[at].max()
            slack = 1e-6 + 1e-9 * (np.abs(near) + reach)  # for rounding
            blocks.append((near + reach + slack, near - reach - slack, at))
        held = _Held(len(search), k)
        for upper, lower, at in sorted(blocks, key=lambda b: -b[0].max(initial=-np.inf)):
            kth = np.maximum(lo, held.score[:, -1])
            visit = (upper[owner] >= kth) & (lower[owner] <= hi) & ((a_label[owner] == label[at[0]]) == same_label)
            todo = np.flatnonzero(visit)
            for i in range(0, len(todo), 512):
                some = todo[i : i + 512]
                anchors, back = np.unique(owner[some], return_inverse=True)
                got = _exact(a[anchors], rows[at])[back]
                good = (got >= kth[some, None]) & (got <= hi[some, None])
                if same_label:
                    good &= a_row[owner[some], None] != row[None, at]
                x, y = np.nonzero(good)
                held.add(some[x], got[x, y].astype(np.float64), vec[at[y]], row[at[y]])
        x, y = np.nonzero(held.score > -np.inf)
        return pa.table({"search": search[x], "row": held.row[x, y], "vec_id": held.vec[x, y], "score": held.score[x, y].astype(np.int64)})

    return run


def _best(index: DataFrame, anchors: DataFrame, found: dict[int, np.ndarray], p: HardNegatives, k: int, same_label: bool) -> DataFrame:
    """search, vec_id, row, score, rank: the best k rows of every search of ``anchors`` (with asks)."""
    key = ["dim", "label"] if same_label else ["dim"]
    groups = index.groupBy(*key).agg(F.ceil(F.count_distinct("block") / p.visit).alias("groups"))
    parts = anchors.groupBy(*key).agg(F.ceil(F.count("*") / p.anchors).alias("parts"))
    shape = groups.join(parts, key)
    columns = [F.col(c) for c in ("row", "vec_id", "q", "cell", "far", "block")]
    if not same_label:
        columns.insert(0, F.col("label"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part, group = F.pmod(F.xxhash64("row"), F.col("parts")), F.pmod(F.xxhash64("block"), F.col("groups"))
    wanted = anchors.join(shape, key).select(*key, *columns, "asks", part.alias("part"), every("groups").alias("group"), F.lit(0).alias("side"))
    none = F.lit(None).cast(dict(anchors.dtypes)["asks"])
    offered = index.join(shape, key).select(*key, *columns, none.alias("asks"), every("parts").alias("part"), group.alias("group"), F.lit(1).alias("side"))
    task = wanted.union(offered).groupBy(*key, "part", "group")
    sent = task.applyInArrow(_visits(found, k, same_label), "search long, row long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "vec_id", "row"))
    return sent.withColumn("rank", nth).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, p: HardNegatives = HardNegatives()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from (vec_id, embedding, label).

    Scores are inner products of the components' floors. An anchor's positives are its best rows of the
    same label, itself left out; a negative is a row of another label with a score within the window that
    the positive's score sets. Equal scores go by the smaller vec_id. Anchors without other rows of their
    label, and pairs without a negative (such as those of a negative positive score), give no row; vectors
    of other lengths never meet. Rows with a null vec_id, label or vector, or a null or non-finite
    component, take no part; rows that share a vec_id are rows of their own, also as anchors. Scores are
    exact up to 2**53. An empty table gives no rows. Other columns are not read.
    """
    q = quantised(rows, p)
    found = _fit(q, p)
    kinds = "dim int, row long, vec_id long, label long, q array<double>"
    dealt = saved(q.select("dim", "row", "vec_id", "label", "q").mapInArrow(_dealer(found), f"{kinds}, cell long, far double"), "dealt")
    sizes = dealt.groupBy("dim", "label", "cell").agg(F.ceil(F.count("*") / p.block).alias("parts"))
    block = F.xxhash64("dim", "label", "cell", F.pmod(F.xxhash64("row"), F.col("parts")))
    index = saved(dealt.join(sizes, ["dim", "label", "cell"]).withColumn("block", block).drop("parts"), "index")
    ask = F.struct(F.col("row").alias("search"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    anchors = index.where(anchor)
    pairs = _best(index, anchors.withColumn("asks", F.array(ask)), found, p, p.positives, True)
    pairs = pairs.select(F.col("search").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("search"))
    pairs = saved(pairs, "pairs")
    # low * positive <= 100 * negative <= high * positive, in whole numbers; nothing fits below 0
    low, high = (F.lit(p.low) * F.col("positive_score") + 99).cast("long"), (F.lit(p.high) * F.col("positive_score")).cast("long")
    window = F.struct("search", F.floor(low / 100).cast("double").alias("lo"), F.floor(high / 100).cast("double").alias("hi"))
    asked = pairs.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).alias("asks"))  # at most ``positives``
    best = _best(index, anchors.join(asked, "row"), found, p, p.negatives, False)
    out = best.select("search", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(pairs, "search").join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
