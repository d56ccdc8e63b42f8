import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm.hard_negatives import HardNegatives, _visits, hard_negatives

import pyarrow as pa


def brute(rows, p=HardNegatives(), anchor=lambda v: v % 50 == 0):
    fine = []
    for i, (vec, e, label) in enumerate(rows):
        if vec is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            fine.append((i, vec, label, [math.floor(float(np.float32(x)) * p.scale) for x in e]))
    out = []
    for i, vec, label, q in fine:
        if not anchor(vec):
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), v, j, lab) for j, v, lab, r in fine if j != i and len(r) == len(q)]
        for s, v, _, _ in sorted(x for x in scored if x[3] == label)[: p.positives]:
            fit = sorted(x for x in scored if x[3] != label and p.low * -s <= 100 * -x[0] <= p.high * -s)[: p.negatives]
            out += [(vec, v, n + 1, w, -s, -t) for n, (t, w, _, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, p=HardNegatives()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 50 == 0, p).collect())


SMALL = HardNegatives(rows_per_list=8, block=10, anchors=3, visit=2, sample=120)


@pytest.mark.parametrize("p", [HardNegatives(), SMALL], ids=["whole", "small"])
def test_against_brute_force(spark, p):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((4, 6))
    rows = [(i, (middle[i % 4] * (0.1 if i % 3 else 0.6) + 0.2 * rng.standard_normal(6)).tolist(), i % 3) for i in range(400)]
    rows += [(1000 + i, rows[50][1], int(i % 2)) for i in range(40)]  # ties
    assert mined(spark, rows, p) == brute(rows, p) and len(brute(rows, p)) > 20


def test_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [(0, one, 1), (50, None, 1), (100, [None, 1.0], 1), (150, [float("nan"), 1.0], 1), (200, one, None), (None, one, 1), (250, [], 1), (300, [0.0, 0.0], 2), (350, [1.0], 1)]
    rows += [(0, one, 1), (1, [0.9, 0.5], 2), (2, [0.7, 0.4], 2), (2, [0.7, 0.4], 2), (3, [-1.0, -1.0], 1), (4, [float("inf"), 1.0], 2)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, rows[:1]) == mined(spark, []) == []
    assert mined(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == []  # a negative positive has no window


def test_clashing_names(spark):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    more = frame.select("*", *(F.lit("x").alias(c) for c in ("row", "q", "block", "search", "rank", "anchor")))
    got = hard_negatives(more, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_blocks_below_the_kth_score_are_not_visited(monkeypatch):
    """Two lists far apart: the search that has its k rows does not open the second."""
    import cuelake.llm.hard_negatives as module

    seen = []
    exact = module._exact
    monkeypatch.setattr(module, "_exact", lambda a, rows: seen.append(len(rows)) or exact(a, rows))
    n, middles = 6, {2: np.array([[100.0, 0.0], [-100.0, 0.0]])}
    q = [[10.0, 0.0]] + [[100.0, float(i)] for i in range(n)] + [[-100.0, float(i)] for i in range(n)]
    asks = [[{"search": 1, "lo": -np.inf, "hi": np.inf}]] + [None] * 2 * n
    table = pa.table({
        "side": [0] + [1] * 2 * n, "dim": [2] * (2 * n + 1), "q": q, "row": list(range(2 * n + 1)), "label": [1] * (2 * n + 1), "vec_id": list(range(2 * n + 1)),
        "cell": [0] + [0] * n + [1] * n, "far": [0.0] + [5.0] * 2 * n, "block": [0] + [7] * n + [8] * n,
        "asks": pa.array(asks, pa.list_(pa.struct([("search", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())]))),
    })
    got = _visits(middles, 2, True)(table).to_pylist()
    assert seen == [n] and [(r["vec_id"], r["score"]) for r in got] == [(1, 1000), (2, 1000)]
