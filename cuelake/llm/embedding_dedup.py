"""Embedding near-duplicates by collision counting on one-dimensional projections.

Vectors of one label are dealt to blocks along a first projection; blocks too far apart on it to
hold a link never meet. Within a pair of blocks every projection is sorted, each vector opens a
window around its own value, and a pair's collisions over all projections are counted. Pairs with a
count that true neighbours nearly always reach are verified by cosine in double precision. A task
returns each vector's number of links and one link towards its local group, never all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved


@dataclass(frozen=True)
class EmbeddingDedup:
    """cosine: the least of a link. projections: how many. width: half a window, in standard
    deviations of a projected difference at that cosine. recall: of the count at that cosine.

    reach: deviations beyond which blocks do not meet. block: vectors a block (expected number).
    """

    cosine: float = 0.98
    projections: int = 32
    width: float = 2.0
    recall: float = 0.99999
    reach: float = 5.5
    block: int = 2048
    seed: int = 11

    @property
    def spread(self) -> float:
        """Standard deviation of a projected difference of unit vectors with that cosine."""
        return math.sqrt(max(2 - 2 * self.cosine, 1e-12))

    @property
    def least(self) -> int:
        """The largest count that a pair at that cosine reaches with probability ``recall``."""
        q, m = math.erf(self.width / math.sqrt(2)), self.projections
        tail = 0.0
        for k in range(m, -1, -1):
            tail += math.comb(m, k) * q**k * (1 - q) ** (m - k)
            if tail >= self.recall:
                return k
        return 0


def _directions(dim: int, p: EmbeddingDedup) -> np.ndarray:
    return np.random.default_rng([p.seed, dim]).standard_normal((dim, p.projections))


def _matrix(column) -> np.ndarray:
    """The list column (of equal lengths) as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # lengths may overflow otherwise
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _first_projection(p: EmbeddingDedup):
    def project(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            place = np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                place[at] = _matrix(batch.column(0).take(pa.array(at))) @ _directions(int(dim), p)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), batch.column(0), pa.array(place)], names=[*batch.schema.names[2:], "dim", "embedding", "place"])

    return project


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            return root
        root = new


def _pairs(p: EmbeddingDedup):
    wide, least = p.width * p.spread, p.least

    def linked(table: pa.Table) -> pa.Table:
        side, ids, times = (table.column(c).to_numpy() for c in ("side", "rep", "times"))
        unit = _matrix(table.column("embedding"))
        at = np.argsort(side, kind="stable")
        ids, times, unit, side = ids[at], times[at], unit[at], side[at]
        # sides: 0 left, 1 right, 2 a block with itself
        own = bool(len(side)) and side[0] == 2
        split = len(side) if own else int(np.searchsorted(side, 1))
        left, right = np.arange(split), np.arange(len(side)) if own else np.arange(split, len(side))
        value = unit @ _directions(unit.shape[1], p)
        order = np.argsort(value[right], axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(right))[:, None], axis=0)
        kind = np.int16 if len(right) < 32000 else np.int32
        rank = np.ascontiguousarray(rank.T.astype(kind))
        ordered = np.take_along_axis(value[right], order, axis=0)
        found = []
        for i in range(0, len(left), 256):
            q = left[i : i + 256]
            count = np.zeros((len(q), len(right)), np.uint8)
            for k in range(p.projections):
                lo = np.searchsorted(ordered[:, k], value[q, k] - wide, "left").astype(kind)
                hi = np.searchsorted(ordered[:, k], value[q, k] + wide, "right").astype(kind)
                count += (rank[k] >= lo[:, None]) & (rank[k] < hi[:, None])
            x, y = np.nonzero(count >= least)
            x, y = q[x], right[y]
            if own:
                x, y = x[x < y], y[x < y]
            for j in range(0, len(x), 65536):
                u, v = x[j : j + 65536], y[j : j + 65536]
                good = (unit[u] * unit[v]).sum(axis=1) >= p.cosine
                found.append((u[good].astype(np.int32), v[good].astype(np.int32)))
        a, b = (np.concatenate(c) if c else np.empty(0, np.int32) for c in (zip(*found) if found else ((), ())))
        links = np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
        root = _local_roots(len(ids), a, b, ids)
        some = np.flatnonzero(links)
        return pa.table({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return linked


def embedding_components(rows: DataFrame, p: EmbeddingDedup = EmbeddingDedup()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Equal vectors of a label are one class and link with each other. Vectors that are null, zero or
    hold null or non-finite components, rows without label, and vectors of different lengths link
    with nothing. Rows that share a vec_id count as vectors of their own. An empty table gives no
    rows. Other columns are not read.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    keyed = rows.select("vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"), F.xxhash64("embedding").alias("h0"), F.xxhash64("embedding", F.lit(1)).alias("h1"))
    key = ["label", "h0", "h1"]
    classes = keyed.where("fine").groupBy(*key).agg(F.min(F.struct("vec_id", "embedding")).alias("x"), F.count("*").alias("times"))
    # a class goes by a number of its own, as rows may share a vec_id
    reps = classes.select("x.embedding", F.size("x.embedding").alias("dim"), F.monotonically_increasing_id().alias("rep"), F.col("x.vec_id").alias("least"), "times", *key)
    kinds = dict(reps.dtypes)
    placed = saved(
        reps.mapInArrow(_first_projection(p), f"rep long, least {kinds['least']}, times long, label {kinds['label']}, h0 long, h1 long, dim int, embedding {kinds['embedding']}, place double"), "placed"
    )
    group = ["label", "dim"]
    shape = placed.groupBy(*group).agg(F.count("*").alias("n"), F.avg("place").alias("mean"), F.coalesce(F.stddev("place"), F.lit(0.0)).alias("sd"))
    # the logistic curve comes near the normal one: blocks of like numbers along the projection
    z = (F.col("place") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1e-9))
    strip = F.floor(F.ceil(F.col("n") / p.block) / (1 + F.exp(-1.702 * z)))
    striped = placed.join(shape, group).withColumn("strip", strip).select(*placed.columns, "strip")
    sizes = striped.groupBy(*group, "strip").agg(F.ceil(F.count("*") / p.block).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    dealt = saved(striped.join(sizes, [*group, "strip"]).withColumn("part", part).select("rep", "times", *group, "embedding", "place", "strip", "part"), "dealt")
    blocks = saved(dealt.groupBy(*group, "strip", "part").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).withColumn("block", F.xxhash64(*group, "strip", "part")), "blocks")
    far = p.reach * p.spread
    l, r = blocks.alias("l"), blocks.alias("r")
    meet = l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in group] + [F.col("l.block") <= F.col("r.block"), F.col("l.lo") <= F.col("r.hi") + far, F.col("r.lo") <= F.col("l.hi") + far])
    pairs = meet.select(F.col("l.block").alias("x"), F.col("r.block").alias("y"))
    same = F.col("x") == F.col("y")
    sides = pairs.select(F.explode(F.when(same, F.array(F.struct(F.col("x").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))).alias("s"), "x", "y")
    members = dealt.withColumn("block", F.xxhash64(*group, "strip", "part")).select("block", "rep", "times", "embedding").join(sides.select("s.block", "s.side", "x", "y"), "block")
    found = saved(members.select("x", "y", "side", "rep", "times", "embedding").groupBy("x", "y").applyInArrow(_pairs(p), "rep long, links long, root long"), "embedding-links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("rep <> root"), "rep", "root")
    named = placed.select(*key, "rep", "least", "times").join(counted, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(firsts, "root").select(*(F.col(c).alias(f"k_{c}") for c in key), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "first")
    back = keyed.join(named, [F.col("fine"), *(F.col(c) == F.col(f"k_{c}") for c in key)], "left")
    out = back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
