"""Each query on all of its input: against brute force, without what once was left out."""

import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from cuelake import registry
from cuelake.functions.text import indel
from cuelake.operators import align, edits, quality_control

QUERIES = registry.queries()


def table(sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def words_of(text):
    return re.findall(r"[^\W]+", text.lower())


def test_censor_tokens_masks_whole_texts(spark, sf):
    mask = re.compile("^(.[^aeiouäöüAEIOUÄÖÜ]*)[aeiouäöüAEIOUÄÖÜ]")
    d = table(sf, "documents").query("lang == 'de'")
    want = {i: " ".join(mask.sub(r"\1*", w, count=1) for w in words_of(t)) for i, t in zip(d.doc_id, d.text)}
    assert max(len(x.split()) for x in want.values()) > 20
    assert {r.doc_id: r.masked for r in QUERIES["censor_tokens"](spark, sf).collect()} == want


def test_alignment_keeps_the_widest_run_within_the_budget():
    """3,300 tokens a side: margins 64 and 256 together pass 2,000,000 cells."""
    left = [f"t{i % 1000:03}" for i in range(3300)]
    right = [f"t{i % 1000:03}" for i in range(3300)]
    left[100], right[900] = "once", "once"  # outside the first band, so its run isn't enough
    left[50], right[50] = "here", "here"
    ops = align.edit_script(left, right)
    assert [o[1] for o in ops if o[1] is not None] == list(range(3300)) == [o[2] for o in ops if o[2] is not None]
    assert sum(o[0] == "match" for o in ops) > 2000
    assert all(left[i] == right[j] for kind, i, j, _ in ops if kind == "match")


def test_alignment_widens_until_the_unique_pairs_match():
    left = ["pp", "qq"] * 100 + ["once"] + ["rr"] * 50
    assert ("match", 200, 300, 1.0) in align.edit_script(left, ["cc"] * 100 + left)
    assert align.edit_script([], ["x"] * 300) == [("insert", None, j, 0.0) for j in range(300)]
    far = align.edit_script(["x"], ["y"] * 100_000)  # no band reaches the end: aligned over all cells
    assert Counter(o[0] for o in far) == {"replace": 1, "insert": 99_999}


def test_style_lint_counts_lines_and_tests_each(spark, sf):
    d = table(sf, "conversations")
    want = Counter()
    for ep, turn, text in zip(d.conv_id, d.turn, d.text):
        lines = text.split("\n")
        want[ep, turn + 1, "line_count"] += len(lines) > 2
        want[ep, turn + 1, "line_length"] += sum(len(x) > 400 for x in lines)
    got = Counter((r.ep, r.cue_id, r.kind) for r in QUERIES["style_lint"](spark, sf).where("kind like 'line%'").collect())
    assert got == +want and {k for *_, k in got} == {"line_count", "line_length"}
    two = spark.createDataFrame([(1, 0, 1, 0, 1000, "é" * 401 + "\n\n" + "x" * 402, None), (1, 1, 2, 1000, 2000, None, None)], "ep long, pos long, cue_id long, start_ms long, end_ms long, text string, speaker string")
    assert sorted(r.kind for r in quality_control.style_lint(two, F.length).collect()) == ["line_count", "line_length", "line_length"]
    total = {r.ep: r.total for r in QUERIES["qc_summary"](spark, sf).collect()}
    assert total == Counter(r.ep for r in QUERIES["style_lint"](spark, sf).collect())


def drifts(tokens, known):
    """J18 over all pairs."""
    n, k, out = Counter(tokens), Counter(known), set()
    for t in set(n) - set(k):
        near = [(k[s], indel(t, s), s) for s in k if len(t) >= 4 and k[s] >= 2 and abs(len(s) - len(t)) <= 3 and indel(t, s) >= 70]
        if near:
            c, ratio, s = min(near, key=lambda x: (-x[0], -x[1], x[2]))
            if c / sum(x[0] for x in near) >= 0.8:
                out.add((t, n[t], s, ratio))
    return out


def test_name_drift_equals_all_pairs(spark):
    r = random.Random(3)
    make = lambda n, letters: ["".join(r.choice(letters) for _ in range(r.choice([*range(1, 12), 17, 30]))) for _ in range(n)]
    base = make(150, "abcde") + make(150, "abcdefghijklmnopqrstuvwxyzäé")
    known = base + [x for x in base for _ in range(r.randint(0, 40))] + ["kate"] * 9 + ["philip"] * 5
    drift = lambda x: "".join(r.choice([c, c, c, c, c, "", c + "k", "q"]) for c in x)
    tokens = [y for y in map(drift, base * 2) if y] + ["cate", "filip", "philip", "phi"]
    one = lambda x: spark.createDataFrame([(t,) for t in x], "token string")
    got = {tuple(x) for x in edits.name_drift(one(tokens), one(known)).collect()}
    assert got == drifts(tokens, known) and {("cate", 1, "kate", 75.0), ("filip", 1, "philip", 200.0 * 4 / 11)} & got
    assert len(got) > 100 and any(len(x[0]) > 12 for x in got) and any(x[0][0] != x[2][0] for x in got)


def test_name_drift_query_equals_all_pairs(spark, sf):
    tokens, known = ([w for t in table(sf, n).text for w in words_of(t)] for n in ("benchmark", "documents"))
    assert {tuple(x) for x in QUERIES["name_drift"](spark, sf).collect()} == drifts(tokens, known)


def test_unique_exact_pairs_of_all_languages_and_long_texts(spark, tmp_path):
    long = " ".join(["a"] * 100_005 + ["late"])
    docs = [(0, long, "en"), (1, "early a", "de"), (20, "late early", None), (40, "eins", "de"), (60, "zwei eins", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["unique_exact_pairs"](spark, str(tmp_path)).collect()}
    far = 2**32
    assert got == {(0, "late", 100_005, 20 * far), (0, "early", far, 20 * far + 1), (40, "eins", 0, 20 * far + 1)}


def bounds(hay, needle):
    k, joined = len(needle), "".join(needle)
    runs = [i for i in range(len(hay) - k + 1) if k and "".join(hay[i : i + k]) == joined]
    return next(iter(runs or [i for i, x in enumerate(hay) if k and x == joined]), None)


def test_subsequence_bounds_finds_short_and_joined_items(spark, tmp_path):
    docs = ["one two", "so on and so forth", "and soon", "x " * 300 + "so on", "into one two three four five six seven", "onetwo one two", "", "abc de fgh ij klm nop qrs tuv"]
    items = ["so on", "two", "in to", "one two three four five six", "one two", "?", "ab cde fg hij klm nop qr stuv", "three four"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {tuple(r) for r in QUERIES["subsequence_bounds"](spark, str(tmp_path)).collect()}
    want = {(i, j, bounds(words_of(x), words_of(y))) for i, x in enumerate(docs) for j, y in enumerate(items)}
    assert got == {x for x in want if x[2] is not None} and {(2, 0, 1), (5, 4, 1), (7, 6, 0)} <= got
