"""The aligner against brute force, and where bands or times matter."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.functions.text import indel
from cuelake.operators import align


def pair_score(x, y):
    ratio = (1.0 if x else 0.0) if x == y else indel(x, y) / 100
    return round(2 * ratio * align.UNIT) if ratio >= align.LIKE else align.UNLIKE_UNITS


def brute(left, right):
    """Steps and score of the best script over all cells; delete before insert before pair."""
    n, m = len(left), len(right)
    best = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i:
                ways.append((best[i - 1][j][0] + align.GAP_UNITS, -align.DELETE))
            if j:
                ways.append((best[i][j - 1][0] + align.GAP_UNITS, -align.INSERT))
            if i and j:
                ways.append((best[i - 1][j - 1][0] + pair_score(left[i - 1], right[j - 1]), -align.PAIR))
            if ways:
                best[i][j] = max(ways)
    steps, i, j = [], n, m
    while i or j:
        kind = -best[i][j][1]
        i, j = i - (kind != align.INSERT), j - (kind != align.DELETE)
        steps.append((kind, i, j))
    return steps[::-1], best[n][m][0]


WORDS = ["a", "bb", "colour", "colours", "colors", "the", "", "zebra", *(f"w{k}" for k in range(6))]


def test_scripts_equal_brute_force():
    r = random.Random(1)
    for _ in range(150):
        left, right = ([r.choice(WORDS) for _ in range(r.randint(0, 25))] for _ in range(2))
        assert align.scripted(left, right) == ([align._operation(left, right, *s) for s in brute(left, right)[0]], False)


def test_halved_parts_are_as_good(monkeypatch):
    monkeypatch.setattr(align, "HELD", 16)
    r = random.Random(2)
    for _ in range(60):
        left, right = ([r.choice(WORDS) for _ in range(r.randint(0, 25))] for _ in range(2))
        steps = align._exact(align.Scores(left, right), 0, len(left), 0, len(right))
        assert [i for k, i, _ in steps if k != align.INSERT] == list(range(len(left))) and [j for k, _, j in steps if k != align.DELETE] == list(range(len(right)))
        assert sum(pair_score(left[i], right[j]) if k == align.PAIR else align.GAP_UNITS for k, i, j in steps) == brute(left, right)[1]


@pytest.mark.parametrize("extra, size, kinds", [(200, 4000, 4000), (0, 16000, 16000), (0, 16000, 900)])
def test_nothing_is_given_up_where_bands_fall_short(extra, size, kinds):
    left = [f"t{i % kinds}" for i in range(size)]
    ops, limited = align.scripted(left, ["zz"] * extra + left)
    assert limited and sum(o[0] == "match" for o in ops) == size and sum(o[0] == "insert" for o in ops) == extra


def test_times_choose_between_repeated_words(spark):
    """A word that is said twice goes to the place that its cue's time tells."""
    cues = [(1, 0, "yes", 1, 10.0, 11.0), (1, 1, "no", 2, 20.0, 21.0)]
    words = [(1, 0, "yes", 1.0, 1.4), (1, 1, "yes", 10.2, 10.6), (1, 2, "no", 20.3, 20.6)]
    c = spark.createDataFrame(cues, "ep long, idx long, token string, cue_id long, start double, end double")
    w = spark.createDataFrame(words, "ep long, idx long, token string, start double, end double")
    pairs = lambda d: {(x.left_idx, x.right_idx) for x in d.where("kind = 'match'").collect()}
    assert pairs(align.align_timed(c, w)) == {(0, 1), (1, 2)}
    late = w.withColumn("start", F.col("start") + 500).withColumn("end", F.col("end") + 500)  # the unique word tells the shift
    assert pairs(align.align_timed(c, late)) == {(0, 1), (1, 2)}
    assert align.band_limited_flags(align.align_timed(c, w)).count() == 0


def test_fits_of_times():
    import numpy as np

    x = np.arange(0, 100, 2.0)
    assert align.fit_times(x, 1.25 * x + 3) == pytest.approx((1.25, 3.0)) and align.fit_times(x, x + 7) == pytest.approx((1.0, 7.0))
    assert align.fit_times(x, 3 * x) is None or align.fit_times(x, 3 * x)[0] == 1.0  # no such rate
    assert align.fit_times(np.empty(0), np.empty(0)) is None and align.fit_times(np.array([1.0]), np.array([9.0])) == (1.0, 8.0)


def test_null_tokens_match_nothing(spark):
    d = spark.createDataFrame([(1, 0, None), (1, 1, "a")], "ep long, idx long, token string")
    assert [x.kind for x in align.align_tokens(d, d).orderBy("op_pos").collect()]== ["replace", "match"]


def test_sides_meet_wherever_they_lie(spark):
    """Both sides lie by episode already, each read in partitions of its own number."""
    w = Window.partitionBy("ep").orderBy("x")

    def side(n):
        t = spark.range(n).select((F.col("id") % 40).alias("ep"), F.col("id").alias("x"), (F.col("id") / 40).cast("int").cast("string").alias("token"))
        return t.select("ep", (F.row_number().over(w) - 1).cast("long").alias("idx"), "token")

    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = align.align_tokens(side(8000), side(400)).groupBy("kind").count().collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert {x["kind"]: x["count"] for x in got} == {"match": 400, "delete": 7600}


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """A small file of long texts gives many rows: no join gathers them in the driver."""
    from cuelake.plans.queries import QUERIES

    spark.range(50).select(F.col("id").alias("p_partkey"), *(F.lit("steel bolt").alias(c) for c in ("p_name", "p_brand", "p_type"))).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("anchor_regions", "divergence_details"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_described_runs_are_dealt_out_as_run(spark, sf):
    """Nor does what a run finds small, once it is shuffled, go to the driver."""
    from cuelake.plans.queries import QUERIES

    d = QUERIES["divergence_details"](spark, sf)
    assert d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan.split("== Initial Plan ==")[0]


def test_short_pairs_side_by_side():
    rng = random.Random(5)
    pairs = [tuple([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2)) for letters in ["abc", ["", "a", "b"], "abcdefgh", ["ab", "b", "abc"]] * 50]
    assert all(align.short(*p) for p in pairs) and not align.short(["words"], ["word"]) and not align.short(["a"] * 65, ["a"])
    who, place, step, i, j = align.short_scripts(pairs)
    got = {k: [] for k in range(len(pairs))}
    for k, _, s, x, y in zip(*(c.tolist() for c in (who, place, step, i, j))):
        got[k].append(align._operation(*pairs[k], s, x, y))
    assert all(got[k] == align.edit_script(*p) for k, p in enumerate(pairs))


def test_long_pairs_side_by_side():
    import numpy as np

    rng = random.Random(7)
    few = ["", "a", "b", "word", "words", "colour", "colours", "sentence", "sentences", "ab", "tnetnoc", "content"]
    many = few + [f"{rng.choice(few)}{k}" for k in range(60)]
    pairs = [([], ["a"]), (["a"], []), ([], [])]
    for names in (few, many) * 12:
        left = [rng.choice(names) for _ in range(rng.randint(1, 260))]
        right = [rng.choice(names) if rng.random() < 0.2 else t for t in left if rng.random() > 0.1]
        at = rng.randint(0, len(right))
        pairs.append((left, right[:at] + [rng.choice(names) for _ in range(rng.choice((0, 3, 150)))] + right[at:]))
    alone = [f"only{k}" for k in range(300)]
    pairs.append((alone, ["zz"] * 90 + alone))  # the narrowest band misses the unique pairs
    sides = [align.Sides(*p) for p in pairs]
    for s, (*steps, limited) in zip(sides, align.scripts(sides)):
        assert ([align._operation(s.left, s.right, *x) for x in zip(*(x.tolist() for x in steps))], limited) == align.scripted(s.left, s.right)
    timed = [s for s in sides if s.n and s.m]
    for s in timed:
        s.priors = np.sort(np.array([rng.random() * 90 for _ in range(s.n)])), np.full(s.n, 2.0 + rng.random() * 9), np.sort(np.array([rng.random() * 90 for _ in range(s.m)]))
    for s, (*steps, limited) in zip(timed, align.scripts(timed)):
        assert ([align._operation(s.left, s.right, *x) for x in zip(*(x.tolist() for x in steps))], limited) == align.scripted(s.left, s.right, s.priors)


def test_words_of_cues_are_not_broadcast(spark, sf):
    """Tokens that explode from a small table of cues are not gathered by the driver."""
    from cuelake.plans.queries import QUERIES

    plan = QUERIES["matched_whole"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tokens_in_pieces(spark):
    """Pieces, rows and batches cut anywhere give the same scripts, and runs are those of the operations."""
    rng = random.Random(3)
    rows = lambda: [(ep, i, [rng.choice([*WORDS, None]) for _ in range(rng.randint(0, 60))]) for ep in [None, *range(30)] for i in range(rng.randint(0, 3))]
    left, right = (spark.createDataFrame(rows(), "ep long, idx long, tokens array<string>") for _ in range(2))
    one = lambda d: d.select("ep", "idx", F.posexplode("tokens").alias("i", "token")).select("ep", (F.col("idx") * 1000 + F.col("i")).alias("idx"), "token")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = align.align_tokens(left, right).orderBy("ep", "op_pos").collect()
        runs = align.aligned_divergences(left, right).orderBy("ep", "first_op").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ops = align.align_tokens(one(left), one(right))
    assert got == ops.orderBy("ep", "op_pos").collect() and {x.ep for x in got} >= {None, 0, 1}
    assert [tuple(x)[:8] for x in runs] == [tuple(x) for x in align.divergences(ops).orderBy("ep", "first_op").collect()]
    at = {(x.ep, x.op_pos): x for x in got}
    for x in runs:
        around = at.get((x.ep, x.first_op - 1)), at.get((x.ep, x.first_op + x.n_ops))
        assert (x.before_left, x.before_right, x.after_left, x.after_right) == tuple(v for y in around for v in ((y.left_idx, y.right_idx) if y else (None, None)))


@pytest.mark.parametrize("name", ["align_tokens", "divergence_spans", "name_divergences"])
def test_tokens_are_dealt_out_in_pieces_and_once(spark, sf, name):
    from cuelake.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Window" not in plan


def test_matches_come_with_their_cue(spark):
    """Pieces of cues give the matches of their tokens; each cue's wording is worked out once."""
    from cuelake.plans.queries import QUERIES

    rng = random.Random(11)
    cues = [(ep, i, [rng.choice(WORDS) for _ in range(rng.randint(0, 30))], rng.choice([None, i]), 2.0 * i, 2.0 * i + 1.5) for ep in range(12) for i in range(rng.randint(0, 4))]
    words = [(ep, i, rng.choice(WORDS), i / 9, i / 9 + 0.1) for ep in range(12) for i in range(rng.randint(0, 70))]
    left = spark.createDataFrame(cues, "ep long, idx long, tokens array<string>, cue_id long, start double, end double")
    right = spark.createDataFrame(words, "ep long, idx long, token string, start double, end double")
    each = left.select("ep", "idx", "cue_id", "start", "end", F.posexplode("tokens").alias("i", "token"))
    each = each.select("ep", (F.row_number().over(Window.partitionBy("ep").orderBy("idx", "i")) - 1).cast("long").alias("idx"), "token", "cue_id", "start", "end")
    ops = align.align_timed(each, right).where("kind = 'match'")
    want = ops.join(each.select("ep", F.col("idx").alias("left_idx"), "cue_id"), ["ep", "left_idx"]).select("ep", "cue_id", "right_idx")
    got = align.timed_matches(left, right)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 50
    plan = QUERIES["matched_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 2


def test_likeness_by_bits():
    import numpy as np

    rng = random.Random(13)
    names, others = (["".join(rng.choice("abcä😀") for _ in range(rng.choice((1, 3, 9, 60, 61, 90)))) for _ in range(60)] for _ in range(2))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    assert align.ratios(names, others, a, b).tolist() == [indel(names[x], others[y]) / 100 for x, y in zip(a.tolist(), b.tolist())]
