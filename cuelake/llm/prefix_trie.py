"""The trie of conversation prefixes, by preorder intervals.

Distinct conversations are ranked in lexicographic order of their turns; in that order a conversation
adds the nodes beyond what it shares with the one before, and a node's subtree is an interval. With
nodes numbered in preorder and every node's subtree end stored, the leaves and the savings of a subtree
are differences of prefix sums at its two ends. Nothing walks the tree and no round is spent on a level.

Ranking takes blocks of a fixed number of turns, ranks the distinct blocks, then blocks of block ranks,
until a conversation is one block, so that a conversation of any length is never held in one place. All
orders are range-sorted tables; running sums add what the partitions before hold, one row a partition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .mixing import word_count


@dataclass(frozen=True)
class PrefixTrie:
    """block: turns (or ranks) compared at once. piece: ids joined before a conversation group's ids are hashed."""

    block: int = 64
    piece: int = 512



def _in_part():
    return Window.partitionBy("part").orderBy("at")


def _parts():
    """Over one row a partition."""
    return Window.orderBy("part")


def in_order(df: DataFrame, *order) -> DataFrame:
    """The rows sorted over all partitions, saved: ``part`` the partition, ``at`` the place, with gaps between partitions."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return saved(placed.withColumn("part", F.shiftright("at", 33)), "ordered")


def running(ordered: DataFrame, **values: Column) -> DataFrame:
    """Running sums of ``values`` in the order of ``in_order``, the row's own value included."""
    rows = ordered.select("*", *(v.cast("long").alias(f"_{c}") for c, v in values.items()))
    totals = rows.groupBy("part").agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in values))
    before = totals.select("part", *((F.sum(f"_{c}").over(_parts()) - F.col(f"_{c}")).alias(f"_before_{c}") for c in values))
    local = rows.select(*ordered.columns, *(F.sum(f"_{c}").over(_in_part().rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{c}") for c in values))
    # one row a partition
    return local.join(F.broadcast(before), "part").select(*ordered.columns, *((F.col(f"_{c}") + F.col(f"_before_{c}")).alias(c) for c in values))


def dense_ranks(ordered: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0: how many distinct keys stand before, in a table that ``in_order`` sorted by the key first."""
    edges = ordered.groupBy("part").agg(F.min_by(key, "at").alias("first"), F.max_by(key, "at").alias("last"), F.min("at").alias("head"))
    opens = edges.select(F.col("head").alias("at"), (F.col("first") != F.lag("last").over(_parts())).alias("opens"))
    rows = ordered.select(*(c for c in ordered.columns if c != key), (F.col(key) != F.lag(key).over(_in_part())).alias("changes"))
    # one row a partition
    marked = rows.join(F.broadcast(opens), "at", "left").withColumn("new", F.coalesce("changes", "opens", F.lit(False))).drop("changes", "opens")
    return running(marked, rank=F.col("new")).drop("new")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), digest (SHA-256 of role and text), words of every turn, saved.

    Turns stand by turn, null first; turns that share it by role, then by digest, so that repeated rows
    are turns of their own. A null role or text is empty. Rows without conv_id belong to no conversation
    and go. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), word_count().alias("words"))
    placed = running(in_order(turns, "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"), n=F.lit(1))
    first = placed.groupBy("conv_id").agg(F.min("n").alias("first"))
    return saved(placed.join(first, "conv_id").select("conv_id", (F.col("n") - F.col("first") + 1).alias("d"), "digest", "words"), "turns")


def spliced(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations with shared openings: ``turns`` of every c begin with the first h of conversation c - c % ``family``.

    h is crc32 of the decimal c, mod ``most``; c's own turns after its first h follow. An absent opening
    conversation gives no turn. Every c of ``turns`` has a row at d = 0, also when no turn is left.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = convs.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("opening"))
    asked = asked.join(convs.select(F.col("conv_id").alias("opening"), "n"), "opening", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    own = turns.join(asked.select("conv_id", "h", "taken"), "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "digest", "words")
    heads = turns.where(F.col("d") < most).select(F.col("conv_id").alias("opening"), "d", "digest", "words")
    opened = asked.join(heads, "opening").where("d <= taken").select("conv_id", "d", "digest", "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.union(opened).union(root)


def _ranked(rows: DataFrame, p: PrefixTrie) -> DataFrame:
    """conv_id, rank, part, at: conversations in lexicographic order, equal ones with one rank and by conv_id."""
    level, place = rows.select("conv_id", "d", F.col("digest").alias("key")), "d"
    while True:
        blocks = level.groupBy("conv_id", F.floor(F.col(place) / p.block).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "key"))), lambda x: x["key"]).alias("keys"))
        ordered = in_order(blocks, "keys", "conv_id", "block")
        ranks = dense_ranks(ordered, "keys")
        if not ordered.where("block > 0").limit(1).count():
            return saved(ranks, "ranks")
        level, place = saved(ranks.select("conv_id", "block", F.col("rank").alias("key")), "ranks"), "block"


def _hashed(batches):
    """Pieces of id lists, sorted by rank and place, into one row a rank."""
    now, conv, count, digest = None, 0, 0, hashlib.sha256()

    def row():
        return pa.RecordBatch.from_pylist([{"k": now, "conv_id": conv, "members": count, "sha": digest.hexdigest()}])

    for batch in batches:
        done = []
        for k, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("rank", "first", "n", "ids"))):
            if k == now:
                digest.update(b"," + ids.encode())
                count += n
                continue
            if now is not None:
                done.append(row())
            now, conv, count, digest = k, first, n, hashlib.sha256(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if now is not None:
        yield row()


def _groups(ranked: DataFrame, p: PrefixTrie) -> DataFrame:
    """k, conv_id (the smallest), members, sha (of the members' ids) of every distinct conversation."""
    piece = F.floor(F.col("n") / p.piece)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = running(ranked, n=F.lit(1)).groupBy("rank", piece.alias("piece")).agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), ids.alias("ids"))
    return pieces.repartition("rank").sortWithinPartitions("rank", "piece").mapInArrow(_hashed, "k long, conv_id long, members long, sha string")


def prefix_trie(rows: DataFrame, p: PrefixTrie = PrefixTrie()) -> DataFrame:
    """The nodes of (conv_id, d, digest, words), a row a turn, with a row at d = 0 for every conversation.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that members beyond the first repeat, over the subtree), ends_sha256 (of the ids of
    the conversations that end here, ascending, comma-joined), preorder and subtree_end (places from 1).
    Conversations that are equal share their nodes. An empty table gives no node, not even a root.
    """
    rows = saved(rows, "rows")
    groups = _groups(_ranked(rows, p), p).join(rows.groupBy("conv_id").agg(F.max("d").alias("len")), "conv_id")
    groups = saved(groups, "groups")
    own = saved(rows.join(groups.drop("sha"), "conv_id"), "own")  # of one conversation a group

    before = own.select((F.col("k") + 1).alias("k"), "d", F.col("digest").alias("other"))
    fresh = own.join(before, ["k", "d"], "left").where("other is null or other <> digest").groupBy("k").agg(F.min("d").alias("fresh"))
    marked = own.join(fresh, "k").select("k", "d", "words", "conv_id", "members", "len", (F.col("d") >= F.col("fresh")).alias("new"))
    # at one depth a node's conversations stand side by side, from the one that adds it on
    numbered = saved(running(in_order(marked, "d", "k"), node=F.col("new")).drop("part", "at", "new"), "numbered")
    nodes = numbered.groupBy("node").agg(F.min("k").alias("k"), F.max("k").alias("last"), F.min("d").alias("d"), F.min("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.min_by("len", "k").alias("len"))
    above = numbered.select("k", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    nodes = nodes.join(above, ["k", "d"], "left").withColumn("ends", F.col("d") == F.col("len"))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("ends") & (F.col("last") == F.col("k"))).cast("long"))

    walked = saved(running(in_order(nodes, "k", "d"), preorder=F.lit(1), leaves=F.col("leaf"), tokens=F.col("own")).drop("part", "at", "len", "words"), "walked")
    stops = walked.groupBy(F.col("k").alias("last")).agg(F.max("preorder").alias("subtree_end"), F.max("leaves").alias("leaves_end"), F.max("tokens").alias("tokens_end"))
    kids = walked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = walked.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = groups.select("k", "sha", F.lit(True).alias("ends"))
    out = walked.join(stops, "last").join(kids, "node", "left").join(parents, "parent", "left").join(ends, ["k", "ends"], "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("tokens_end") - F.col("tokens") + F.col("own")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "preorder", "subtree_end",
    )
