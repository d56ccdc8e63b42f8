"""MinHash near-duplicates with odd sketches.

Every distinct shingle set gets k MinHash samples. Bands of them give candidate buckets; the same
samples, folded into a parity bitmap (an odd sketch), let a pair's XOR population count estimate its
similarity, so that only likely pairs fetch their sets. Links are confirmed on the full sets.

Copies with equal sets are one node. A bucket with many nodes is not expanded into pairs: in each
round its nodes meet one of them only (a star), and what is linked then counts as one component.
From the second round on a bucket is cut up by one band more, another in each round, so that a node
meets one that is more like it. Only nodes of a bucket that are still apart after the rounds are
compared with each other, so no link between components is left out.

What moves for every band is a key and a node's number. Sketches move once for each different pair,
and full sets only those of nodes that share a bucket, hashed once for all rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, saved
from .wordscan import mix, shingle_sets, text_blocks


@dataclass(frozen=True)
class NearDedup:
    """words: words a shingle. num/den: the least similarity. rows: MinHash samples a band.

    miss: the chance that a pair just at the limit shares no band. samples: MinHash samples in the
    odd sketch (the bands' and more, as more tell high similarities apart better). bits: its size.
    slack: standard deviations below the limit at which a sketch still passes. rounds: star rounds.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    miss: float = 1e-5
    samples: int = 800
    bits: int = 2048
    slack: float = 3.2
    rounds: int = 4

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.num / self.den) ** self.rows))

    @property
    def most_odd(self) -> int:
        """The most differing bits with which a pair may still reach the similarity."""
        k, n, t = max(self.samples, self.bands * self.rows), self.bits, self.num / self.den
        apart = k * (1 - t) + self.slack * math.sqrt(k * t * (1 - t))  # samples that differ
        odd = n / 2 * (1 - math.exp(-4 * apart / n))  # each toggles two bits
        return min(n, math.ceil(odd + self.slack * math.sqrt(apart * apart * 2 / n)))


def _sketcher(p: NearDedup):
    banded = p.bands * p.rows
    k = max(p.samples, banded)
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    mul, add = (seed[:k] | np.uint64(1)).astype(np.uint32) | np.uint32(1), seed[k:].astype(np.uint32)
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) << np.uint64(20))
    band_salt = mix(np.arange(1, p.bands + 1, dtype=np.uint64) << np.uint64(40))

    def samples(s: np.ndarray) -> np.ndarray:
        x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            low = np.minimum(low, (x[i : i + 512, None] * mul + add).min(axis=0))
        return low

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in text_blocks(batch.column(1)):
                sets = shingle_sets(texts, p.words)
                n = np.array([len(s) for s in sets], np.int64)
                low = np.array([samples(s) for s in sets], np.uint32).reshape(j - i, k)
                with np.errstate(over="ignore"):
                    sig = np.array([[np.bitwise_xor.reduce(mix(s)) if len(s) else 0, s.sum(dtype=np.uint64)] for s in sets], np.uint64)
                    mixed = mix(low.astype(np.uint64) ^ salt)
                    keys = mix(mixed[:, :banded].reshape(j - i, p.bands, p.rows).sum(axis=2, dtype=np.uint64) + band_salt)
                spot = (mixed % np.uint64(p.bits)).astype(np.int64) + np.arange(j - i)[:, None] * p.bits
                odd = (np.bincount(spot.ravel(), minlength=(j - i) * p.bits) & 1).astype(np.uint8)
                odd = np.packbits(odd.reshape(j - i, p.bits), axis=1).view(np.int64)
                wrap = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64)), wrap(keys), wrap(np.ascontiguousarray(odd))],
                    ["row", "n_shingles", "sig0", "sig1", "bands", "odd"],
                )

    return sketch


def sketches(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, hash of the text, n_shingles, signature of the set, band keys, odd sketch of every row."""
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("row"), "text").mapInArrow(
        _sketcher(p), "row struct<doc_id:long,h:long>, n_shingles long, sig0 long, sig1 long, bands array<long>, odd array<long>"
    ).select("row.*", "n_shingles", "sig0", "sig1", "bands", "odd")


def _hasher(p: NearDedup):
    def hashed(batches):
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                sets = shingle_sets(texts, p.words)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    return hashed


def shingles(docs: DataFrame, nodes: DataFrame, p: NearDedup) -> DataFrame:
    """(node, its full shingle set) of ``nodes`` (node, doc_id, h); rows that repeat a text count once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return texts.join(nodes, ["doc_id", "h"]).groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_hasher(p), "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    union = F.size("sa").cast("long") + F.size("sb") - F.col("both")
    return both.where((F.col("both") > 0) & (p.den * F.col("both") >= p.num * union)).select("a", "b")


def _components(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, h, n_shingles, component_id, first: whether the row is its component's least (doc_id, text)."""
    everything = saved(sketches(docs, p), "sketches")
    keyed = ["sig0", "sig1", "n_shingles"]
    sized = everything.where("n_shingles > 0 and doc_id is not null")
    nodes = sized.groupBy(*keyed).agg(F.min(F.struct("doc_id", "h", "bands", "odd")).alias("x")).select(*keyed, "x.*")
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the numbers are fixed once written
    sketch = [f"o{i}" for i in range(p.bits // 64)]  # columns: quicker to compare than an array
    wide = nodes.select("node", F.col("n_shingles").alias("n"), *(F.col("odd")[i].alias(c) for i, c in enumerate(sketch)))
    cuts = [f"cut{t}" for t in range(1, p.rounds)]
    band = nodes.select("node", "bands", F.posexplode("bands").alias("band", "key"))
    band = band.select("band", "key", "node", *(F.get("bands", (F.col("band") + t) % p.bands).alias(c) for t, c in enumerate(cuts, 1)))
    shared = band.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = saved(band.join(shared, ["band", "key"]).withColumn("comp", F.col("node")), "members")
    candidates = nodes.select("node", "doc_id", "h").join(members.select("node").distinct(), "node")
    sets = saved(shingles(docs, candidates, p), "shingles")
    differ = lambda l, r: sum((F.bit_count(F.col(f"{l}{c}").bitwiseXOR(F.col(f"{r}{c}"))) for c in sketch), F.lit(0))
    # sets of too different sizes cannot reach the similarity, and sketches tell most others
    near = lambda l, r: (p.den * F.least(f"{l}n", f"{r}n") >= p.num * F.greatest(f"{l}n", f"{r}n")) & (differ(l, r) <= p.most_odd)
    links = tried = comps = None
    for turn in range(p.rounds + 1):
        if turn < p.rounds:  # a bucket's nodes with one of them
            bucket = ["band", "key"] if turn == 0 else ["band", "key", f"cut{turn}"]
            mine = members.select(*bucket, "node", "comp")
            head = mine.groupBy(*bucket).agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "comp")).alias("x")).select(*bucket, F.col("x.node").alias("head"), F.col("x.comp").alias("head_comp"))
            met = mine.join(head, bucket).where("comp <> head_comp")
            pairs = met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            named = lambda c: wide.select(*(F.col(x).alias(f"{c}_{x}") for x in wide.columns)).withColumnRenamed(f"{c}_node", c)
            pairs = pairs.join(named("a"), "a").join(named("b"), "b").where(near("a_", "b_")).select("a", "b")
        else:
            full = members.select("band", "key", "node", "comp").join(wide, "node").join(nodes.select("node", "bands"), "node")
            # a pair is taken from the first band that both share, and from one side
            later = F.exists(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: (i < F.col("l.band")) & (F.get("l.bands", i) == F.get("r.bands", i)))
            met = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") < F.col("r.comp")) & near("l.", "r.") & ~later
            pairs = full.alias("l").join(full.alias("r"), met).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        found = saved(confirmed(pairs, sets, p), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        comps = connected_components(links)
        if turn < p.rounds:
            grown = members.drop("comp").join(comps.select("node", F.col("component").alias("c")), "node", "left").withColumn("comp", F.coalesce("c", "node")).drop("c")
            apart = grown.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
            fresh = saved(grown.join(apart, ["band", "key"]).select(*members.columns), "members")
            forget(members)
            members = fresh
            if members.isEmpty():
                break
    placed = nodes.select(*keyed, "node", "doc_id", "h").join(comps, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = placed.groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    classes = placed.select(*keyed, "label").join(least, "label").select(*keyed, "least")
    mine = everything.select("doc_id", "h", *keyed).join(classes, keyed, "left")
    own = F.col("least").isNull() | F.col("doc_id").isNull()
    return mine.select(
        "doc_id", "h", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id"),
        (own | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("h") == F.col("least.h")))).alias("first"),
    )


def near_components(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows without words, or with a null text, are components of their own and kept. Rows that share a
    doc_id are compared by their own texts; each gets the smallest doc_id reachable from its text. A
    null doc_id stays unlinked and is kept, with a null component_id. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    got = _components(docs, p).drop("h", "first")
    return got.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, and of texts
    that share it the one with the smallest hash.

    Rows with equal doc_id and text are one document and stay or go together. Rows without words, or
    without doc_id, stay. Extra columns pass through unread.
    """
    gone = _components(docs, p).where("not first").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti")
