"""Language ID by a bit-sliced Bloom filter whose slots are language bitmasks.

One look-up of an n-gram, the AND of its slots' masks, gives every language that has the n-gram.
Per language the hits in a text are counted, corrected for the filter's false positives, and the
language with most hits wins.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, saved
from .wordscan import mix, text_blocks


@dataclass(frozen=True)
class LangId:
    """n: letters a gram. rows_per_lang: texts a language learns from (expected number).

    grams_per_lang: grams a language keeps. near: least share of the best language's frequency with
    which a gram still belongs to a language. bits: log2 of the filter's slots. hashes: slots a gram.
    """

    n: int = 3
    rows_per_lang: int = 3000
    grams_per_lang: int = 20_000
    near: float = 0.3
    bits: int = 19
    hashes: int = 2


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    masks: np.ndarray  # slots x 64-language words
    false_rate: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _grams(texts: list[str | None], n: int):
    """(gram hashes, text of each, whether a text has a letter); white space and signs are one gap."""
    joined = "\x00".join(["", *((t or "").replace("\x00", " ").lower() for t in texts), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(code == 0) - 1
    letter = _letters()[code]
    keep = letter | np.concatenate([[False], letter[:-1]])  # a letter, or the gap after one
    lettered = np.bincount(owner[letter], minlength=len(texts) + 1)[: len(texts)] > 0
    char, owner = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    char, owner = np.insert(char, start, 32), np.insert(owner, start, owner[start])  # and one at the start
    owner[char == 32] = np.minimum(owner[char == 32], len(texts) - 1)
    m = len(char) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), lettered
    with np.errstate(over="ignore"):
        h = char[:m].copy()
        for i in range(1, n):
            h = h * np.uint64(0x100000001B3) + char[i : m + i]
    inside = owner[:m] == owner[n - 1 :]
    return mix(h[inside]), owner[:m][inside], lettered


def _slots(h: np.ndarray, bits: int, hashes: int):
    for k in range(hashes):
        yield ((h >> np.uint64(k * 24 % 40)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counter(n: int):
    def count(batches):
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1), 1 << 18):
                langs = batch.column(0).slice(i, j - i).to_pylist()
                for lang in sorted(set(langs)):
                    h, _, _ = _grams([t for t, g in zip(texts, langs) if g == lang], n)
                    gram, times = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])

    return count


def fit(docs: DataFrame, p: LangId = LangId()) -> LangModel | None:
    """Learn from a bounded sample of the rows outside the held-out fold; None without any."""
    rows = docs.where("lang is not null and text is not null").where(fold() != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, p.rows_per_lang / n) * (1 << 20))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(1 << 20)) < share)
    sample = sample.select("lang", "text").dropDuplicates(["lang", "text"])
    counts = sample.mapInArrow(_counter(p.n), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = saved(counts.where("n > 1"), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("freq", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("freq").alias("best"))
    owned = rated.join(best, "gram").where(F.col("freq") >= p.near * F.col("best"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = owned.withColumn("rank", rank).where(F.col("rank") <= p.grams_per_lang).select("lang", "gram").collect()
    langs = sorted(sizes)
    masks = np.zeros((1 << p.bits, (len(langs) + 63) // 64), np.uint64)
    for k, lang in enumerate(langs):
        mine = np.array([r["gram"] for r in chosen if r["lang"] == lang], np.int64).view(np.uint64)
        for slot in _slots(mine, p.bits, p.hashes):
            masks[np.unique(slot), k // 64] |= np.uint64(1 << k % 64)
    filled = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    return LangModel(langs, masks, filled**p.hashes)


def hits(texts: list[str | None], m: LangModel, p: LangId):
    """Per text: grams looked up, grams by language, whether it has a letter."""
    h, owner, lettered = _grams(texts, p.n)
    has = np.full((len(h), m.masks.shape[1]), ~np.uint64(0))
    for slot in _slots(h, p.bits, p.hashes):
        has &= m.masks[slot]
    total = np.bincount(owner, minlength=len(texts))
    per = [np.bincount(owner[((has[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)], minlength=len(texts)) for k in range(len(m.langs))]
    return total, np.stack(per, 1), lettered


def _predictor(m: LangModel, p: LangId):
    names = np.array([*m.langs, "und"], object)

    def predict(batches):
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(batch.num_columns - 1), 1 << 18):
                if len(texts) == 1 and len(texts[0] or "") > 1 << 20:  # a long text, piece by piece
                    got = [hits([texts[0][k : k + (1 << 20)]], m, p) for k in range(0, len(texts[0]), 1 << 20)]
                    total, per, lettered = sum(g[0] for g in got), sum(g[1] for g in got), np.logical_or.reduce([g[2] for g in got])
                else:
                    total, per, lettered = hits(texts, m, p)
                real = np.maximum(per - total[:, None] * m.false_rate, 0) / (1 - np.minimum(m.false_rate, 0.999))
                order = np.argsort(-real, axis=1, kind="stable")
                row = np.arange(len(real))
                top = real[row, order[:, 0]]
                second = real[row, order[:, 1]] if real.shape[1] > 1 else np.zeros_like(top)
                lang = np.where(lettered, order[:, 0], len(m.langs))
                score = np.where(lettered & (top > 0), top / np.maximum(top + second, 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(names[lang].tolist(), pa.string()), pa.array(score)],
                    [*batch.schema.names[:-1], "lang_pred", "score"],
                )

    return predict


def language(docs: DataFrame, m: LangModel | None, p: LangId = LangId()) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the text alone.

    ``und`` and score 0 where the text is null or has no letter, and for all rows if nothing was
    learned. A text none of whose grams is known gets the first language by code point, score 0.
    Repeated rows are answered alike; other columns are not read.
    """
    if m is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predictor(m, p), f"doc_id {kind}, lang_pred string, score double")
