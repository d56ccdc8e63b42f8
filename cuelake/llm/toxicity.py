"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds of toxic against other documents with an informative Dirichlet prior. Tokens
that are clearly toxic score their log-odds, all others a small penalty, so that every maximal
segment found by one linear scan is a passage. Extreme-value statistics calibrate segments: lambda
solves E[exp(lambda X)] = 1 over the scores X of the tokens of other documents, and the upper tail of
their segments' scores tells K, as K n exp(-lambda S) segments of score S or more are chance in n
tokens. The excess of each segment over chance is summed, and a logistic curve, fitted on rows that the
odds were not learned from, turns the sum into a probability. How much the prior weighs and how many
chance tokens the lexicon may hold is chosen by how well that curve fits those rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import fold, saved
from .wordscan import ALNUM, scan, shingle_sets, text_blocks


@dataclass(frozen=True)
class Toxicity:
    """max_rows: labelled rows to learn from (expected number). max_tokens: tokens in the lexicon.

    curve: one of so many learned rows is kept for the curve and for the choice between ``tries``: pairs of
    the Dirichlet prior's weight, as a share of the documents learned from, and the share of the lexicon's
    tokens that chance brings in. penalty: the score of any other token. min_docs: documents a scoring
    token stands in. tail: the quantile of the gains above which segments tell K.
    """

    max_rows: int = 20_000
    curve: int = 3
    tries: tuple[tuple[float, float], ...] = ((0.15, 0.2), (0.05, 0.2), (0.5, 0.2), (0.15, 0.05))
    max_tokens: int = 20_000
    tail: float = 0.75
    min_docs: int = 4
    penalty: float = 0.05
    bins: int = 400


@dataclass(frozen=True)
class ToxicModel:
    tokens: np.ndarray  # sorted hashes
    odds: np.ndarray
    penalty: float
    rate: float  # lambda
    log_k: float
    slope: float
    bias: float


def segments(at: np.ndarray, gain: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score), from the gaining tokens alone.

    The rest of the tokens cost ``penalty`` each; a segment begins and ends at a gaining token.
    """
    left, right, total = [], [], 0.0
    spans: list[tuple[int, int]] = []
    previous = -1
    for i, (place, g) in enumerate(zip(at.tolist(), gain.tolist())):
        total -= penalty * (place - previous - 1)
        lo, total = total, total + g
        previous, first = place, i
        low, high = lo, total
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j -= 1
            if j < 0 or right[j] >= high:
                left.append(low)
                right.append(high)
                spans.append((first, i))
                break
            low, first = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:]
    return [(int(at[a]), int(at[b]), r - l) for (a, b), l, r in zip(spans, left, right)]


def _cluster(batches):
    """The least 3-word shingle of each text: copies and most near copies share it."""
    for batch in batches:
        for i, j, texts in text_blocks(batch.column(0)):
            low = [int(s[0].view(np.int64)) if len(s) else 0 for s in shingle_sets(texts, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), *(c.slice(i, j - i) for c in batch.columns)], ["cluster", "text", "toxic"])


def _presence(batches):
    for batch in batches:
        toxic = np.asarray(batch.column(1))
        for i, j, texts in text_blocks(batch.column(0)):
            words, bounds = scan(texts, ALNUM)
            parts = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            if len(words):
                flag = np.repeat(toxic[i:j], [len(p) for p in parts]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(flag)], ["token", "toxic"])


def _finder(m: ToxicModel):
    near = np.zeros(1 << 16, bool)
    near[(m.tokens & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(texts):
        """Per text: number of tokens and its segments."""
        words, bounds = scan(texts, ALNUM)
        hit = np.flatnonzero(near[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if len(m.tokens):
            spot = np.minimum(np.searchsorted(m.tokens, words[hit]), len(m.tokens) - 1)
            same = m.tokens[spot] == words[hit]
            hit, gain = hit[same], m.odds[spot[same]]
        else:
            hit, gain = hit[:0], np.empty(0)
        cut = np.searchsorted(hit, bounds)
        for n in range(len(texts)):
            a, b = cut[n], cut[n + 1]
            yield int(bounds[n + 1] - bounds[n]), segments(hit[a:b] - bounds[n], gain[a:b], m.penalty) if b > a else []

    return found


def beats_chance(n: int, found: list[tuple[int, int, float]], m: ToxicModel) -> float:
    floor = m.log_k + math.log(max(n, 1))
    return sum(max(0.0, m.rate * s - max(floor, 0.0)) for _, _, s in found)


def _scorer(m: ToxicModel):
    found = _finder(m)

    def score(batches):
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(batch.num_columns - 1)):
                stat, passages = [], []
                for n, seg in found(texts):
                    stat.append(beats_chance(n, seg, m))
                    floor = max(m.log_k + math.log(max(n, 1)), 0.0)
                    passages.append([{"first": a, "last": b, "score": s} for a, b, s in seg if m.rate * s > floor])
                x = m.slope * np.log1p(np.array(stat)) + m.bias
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
                cols += [pa.array(np.array(stat, float)), pa.array(1 / (1 + np.exp(-x)))]
                cols += [pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "bits", "score", "passages"])

    return score


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> ToxicModel:
    """Learn from at most about ``max_rows`` labelled rows outside the held-out fold.

    The sample's ids are few whatever the tables' sizes, so they are broadcast and no text moves
    to meet them. Rows of one label whose texts share their least shingle count once, so that copies do not
    outweigh the rest. With no toxic or no other row the model scores all texts alike.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold() != 0)
    share = min(1.0, p.max_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    texts = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_cluster, "cluster long, text string, toxic int")
    later = (F.pmod(F.xxhash64("cluster", F.lit(3)), F.lit(p.curve)) == 0).alias("later")
    sample = saved(texts.dropDuplicates(["cluster", "toxic"]).select("text", "toxic", later), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), sum(v for k, v in size.items() if k != 1)
    if not n1 or not n0:
        return _flat(n1, n0, p)
    # the curve's rows are strange to the odds that it is fitted on; with few rows one class may be missing
    early, strange = sample.where("not later"), sample.where("later")
    both = strange.agg(F.count_distinct(F.col("toxic") == 1)).first()[0] == 2 and early.agg(F.count_distinct(F.col("toxic") == 1)).first()[0] == 2
    best = _chosen(early, strange, p) if both else None
    try_ = best[0] if best else p.tries[0]
    m = _odds(_token_counts(sample), sample, try_, p)
    if m is None:
        return _flat(n1, n0, p)
    slope, bias = best[1] if best else _curve(m, sample, p)[:2]
    return replace(m, slope=slope, bias=bias)


def _flat(n1: int, n0: int, p: Toxicity) -> ToxicModel:
    """What scores all texts alike."""
    return ToxicModel(np.empty(0, np.uint64), np.empty(0), p.penalty, 1.0, 0.0, 0.0, math.log((n1 + 1) / (n0 + 1)))


def _chosen(early: DataFrame, strange: DataFrame, p: Toxicity) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """A try and its curve: the first whose curve loses no more on the strange rows than the best one's, but for a standard error."""
    counts = saved(_token_counts(early), "toxic-counts")
    found = []
    for try_ in p.tries:
        m = _odds(counts, early, try_, p)
        if m is not None:
            slope, bias, loss, error = _curve(m, strange, p)
            found.append((loss, error, try_, (slope, bias)))
    if not found:
        return None
    least, error = min((loss, error) for loss, error, *_ in found)
    return next(x[2:] for x in found if x[0] <= least + error)


def _curve(m: ToxicModel, rows: DataFrame, p: Toxicity) -> tuple[float, float, float, float]:
    """(slope, bias, mean loss, its standard error) of the logistic curve over the rows' bits, counted in ``bins`` at most."""
    step = F.least(F.floor(F.log1p("bits") * 40), F.lit(p.bins))
    scored = rows.select(F.col("toxic").alias("y"), "text").mapInArrow(_scorer(m), f"y int, bits double, score double, passages {PASSAGES}")
    curve = scored.groupBy(step.alias("x"), (F.col("y") == 1).alias("y")).agg(F.count("*").alias("n")).collect()
    x, y, w = (np.array(c, float) for c in zip(*((r["x"] / 40 + 0.0125 * (r["x"] > 0), r["y"], r["n"]) for r in curve)))
    slope, bias = _logistic(x, y, w)
    sign = np.where(y == 1, -1.0, 1.0)
    loss = np.logaddexp(0.0, sign * (slope * x + bias))
    mean = float(np.average(loss, weights=w))
    return slope, bias, mean, math.sqrt(float(np.average((loss - mean) ** 2, weights=w)) / w.sum())


def _token_counts(learn: DataFrame) -> DataFrame:
    """token, y1, y0: toxic and other documents that it stands in; with a null token, how many there are."""
    both = F.sum((F.col("toxic") == 1).cast("double")).alias("y1"), F.sum((F.col("toxic") != 1).cast("double")).alias("y0")
    tokens = learn.select("text", "toxic").mapInArrow(_presence, "token long, toxic long")
    return tokens.groupBy("token").agg(*both).union(learn.agg(F.lit(None).cast("long").alias("token"), *both))


def _odds(counts: DataFrame, learn: DataFrame, try_: tuple[float, float], p: Toxicity) -> ToxicModel | None:
    """Lexicon, lambda and K from token counts and the rows (text, toxic) they come from; none where no token tells classes apart."""
    prior, false_share = try_
    size = counts.where("token is null").first()
    n1, n0 = size["y1"] or 0.0, size["y0"] or 0.0
    if not n1 or not n0:
        return None
    weight = prior * (n1 + n0)
    a = (F.col("y1") + F.col("y0")) / (n1 + n0) * weight + 0.01
    l1, l0 = (F.col("y1") + a) / (n1 + weight - F.col("y1") - a + 1), (F.col("y0") + a) / (n0 + weight - F.col("y0") - a + 1)
    scored = counts.where("token is not null").withColumn("odds", F.log(l1) - F.log(l0)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)))
    tested = scored.where(F.col("y1") >= p.min_docs)
    tests = tested.count()
    best = tested.where("odds > 0").orderBy(F.desc("z"), "token").limit(p.max_tokens).collect()
    chosen = best[: _not_by_chance([r["z"] for r in best], tests, false_share)]
    if not chosen:
        return None
    keys = np.array([r["token"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(keys)
    m = ToxicModel(keys[order], np.array([r["odds"] for r in chosen])[order], p.penalty, 1.0, 0.0, 1.0, 0.0)
    others = learn.where("toxic <> 1").select("text")
    seen = {r["token"]: r["n"] for r in others.mapInArrow(_occurrences(m), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    share = (np.array([seen.get(int(t), 0) for t in m.tokens.view(np.int64)]) + 0.5) / (max(seen.get(None, 0), 1) + len(m.tokens))
    gain = float((share * m.odds).sum())
    m = replace(m, penalty=max(p.penalty, 1.1 * gain / (1 - share.sum())))  # else chance segments have no end
    m = replace(m, rate=_rate(share, m.odds, m.penalty))
    high = float(np.quantile(m.odds, p.tail))
    found = others.mapInArrow(_segment_counts(m, high), "n long, segments long, high long").groupBy().agg(F.sum("n").alias("n"), F.sum("segments").alias("k"), F.sum("high").alias("high")).first()
    # K from the tail, or where it is empty from all segments: they score the least gain or more
    k, least = (found["high"], high) if found["high"] else (found["k"] or 0, float(m.odds.min()))
    return replace(m, log_k=math.log(max(k, 0.5) / max(found["n"] or 1, 1)) + m.rate * least)


def _not_by_chance(z: list[float], tests: int, false_share: float) -> int:
    """How many of the highest z-scores to take so that about ``false_share`` of them are chance, out of ``tests``."""
    k = 0
    for i, x in enumerate(z, 1):
        if 0.5 * math.erfc(x / math.sqrt(2)) <= false_share * i / tests:
            k = i
    return k


def _rate(share: np.ndarray, odds: np.ndarray, penalty: float) -> float:
    """Lambda: the positive number at which exp(lambda * score) has mean 1 over chance tokens."""
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        mean = float((share * np.exp(np.minimum(mid * odds, 600))).sum() + (1 - share.sum()) * math.exp(-mid * penalty))
        lo, hi = (mid, hi) if mean < 1 else (lo, mid)
    return lo


def _occurrences(m: ToxicModel):
    """How often each token of the lexicon stands in some texts; with a null token, how many tokens they have."""
    tokens = m.tokens

    def count(batches):
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                words, _ = scan(texts, ALNUM)
                spot = np.minimum(np.searchsorted(tokens, words), len(tokens) - 1)
                n = np.bincount(spot[tokens[spot] == words], minlength=len(tokens))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([*tokens[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[some].tolist(), len(words)], pa.int64())], ["token", "n"])

    return count


def _segment_counts(m: ToxicModel, high: float):
    """Tokens, maximal segments, and those that score ``high`` or more, of each text."""
    found = _finder(m)

    def count(batches):
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                rows = [(n, len(seg), sum(s >= high for _, _, s in seg)) for n, seg in found(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n", "segments", "high"])

    return count


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton steps with a slight ridge, so that separable data end too."""
    b = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (w * (y - q)) - 0.1 * b * [1, 0]
        hess = (design * (w * q * (1 - q))[:, None]).T @ design + np.diag([0.1, 1e-6])
        b += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(b[0], 0.0)), float(b[1])


PASSAGES = "array<struct<first:bigint,last:bigint,score:double>>"


def toxicity(docs: DataFrame, m: ToxicModel) -> DataFrame:
    """doc_id, bits, score, passages (token spans) of every row; only the text is looked at.

    Null and empty texts have no segments and get the score of a text without any. Repeated rows
    are scored alike; other columns are not read. A doc_id of any type passes through.
    """
    span = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("score", DoubleType())])
    judged = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("bits", DoubleType()), StructField("score", DoubleType()), StructField("passages", ArrayType(span))])
    return docs.select("doc_id", "text").mapInArrow(_scorer(m), judged)
