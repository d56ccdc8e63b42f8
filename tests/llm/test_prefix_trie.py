import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cuelake.llm.prefix_trie import PrefixTrie, numbered_turns, prefix_trie, spliced


def brute(rows):
    """The contract's nodes of (conv_id, turn, role, text) rows, by plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == path)))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame, p=PrefixTrie()):
    return [tuple(r) for r in prefix_trie(spliced(numbered_turns(frame)), p).select(*COLUMNS).collect()]


def test_against_brute_force_with_small_blocks(spark):
    rng, rows = random.Random(3), []
    for conv in [*range(0, 60), 123, 140]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([None, turn, turn]), rng.choice(["user", None]), rng.choice(["a b", "a b", "c", None, "long text of seven words in all"])))
    rows += [(7, t, "user", "again") for t in range(100, 140)] + [(None, 1, "user", "nobody's"), (200, 0, "x", "same"), (200, 0, "x", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = nodes(frame, PrefixTrie(block=2, piece=3))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert set(nodes(frame)) == set(got)


def test_preorder_intervals_nest(spark, sf):
    turns = spliced(numbered_turns(spark.read.parquet(f"{sf}/conversations.parquet")))
    rows = prefix_trie(turns).orderBy("preorder").collect()
    assert [r.preorder for r in rows] == list(range(1, len(rows) + 1)) and rows[0].depth == 0 and rows[0].subtree_end == len(rows)
    for r in rows:
        inside = rows[r.preorder - 1 : r.subtree_end]
        assert all(x.depth > r.depth for x in inside[1:]) and (r.subtree_end == len(rows) or rows[r.subtree_end].depth <= r.depth)
        assert sum(x.depth == r.depth + 1 for x in inside) == r.n_children


def test_turnless_conversations_clashing_names_and_empty_tables(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)  # its only turn goes, no opening is there
    frame = spark.createDataFrame([(c, 1, "u", "gone", 5, 6)], "conv_id long, turn long, role string, text string, d int, `k` int")
    assert nodes(frame) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert nodes(frame.where("false")) == []
    one = spark.createDataFrame([(40, None, None, None)], "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1))
    assert set(nodes(one)) == brute([(40, None, None, None)])


def test_very_long_texts_and_a_hot_conversation(spark):
    rows = [(20, t, "user", "word " * (20_000 if t == 5 else 2)) for t in range(600)] + [(c, t, "user", "word " * 2) for c in range(21, 60) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert set(nodes(frame)) == brute(rows)
