"""Substring deduplication by content-defined chunks.

A gear rolling hash over the words' fingerprints (four words deep) cuts each text where its top bits
are small, so a passage is cut alike wherever it stands and an insertion moves no later cut. Chunks
are told apart by digest. The smallest doc_id that holds a chunk keeps it; in other documents a run
of repeated chunks of ``min_words`` words or more is taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import columns_of, saved
from .wordscan import mix, scan_spans, text_blocks


@dataclass(frozen=True)
class SubstringDedup:
    """mean_words: words a chunk on average. min_words: the shortest repeated run that goes."""

    mean_words: int = 6
    min_words: int = 16


def _chunks(texts: list[str | None], p: SubstringDedup):
    """Per chunk: text's index, first word, words, digest; then the words' spans and bounds."""
    words, bounds, starts, ends = scan_spans(texts)
    gear = mix(words ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint16)
    rolled = gear.copy()
    for back in (1, 2, 3):  # h = (h << 4) + gear, in 16 bits: older words are shifted out
        rolled[back:] += gear[:-back] << np.uint16(4 * back)
    new_text = np.zeros(len(words) + 1, bool)
    new_text[bounds] = True
    cut = rolled < 65536 // p.mean_words
    for back in range(4):  # near a text's start the hash would see the text before
        spot = bounds[:-1] + back
        cut[spot[spot < bounds[1:]]] = False
    first = np.flatnonzero(np.concatenate([[True], cut[:-1]]) | new_text[:-1]) if len(words) else np.empty(0, np.int64)
    size = np.diff(first, append=len(words))
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - np.repeat(first, size)
        weight = mix(place.astype(np.uint64) + np.uint64(11)) | np.uint64(1)
        digest = mix(np.add.reduceat(mix(words) * weight, first) + size.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
    owner = np.searchsorted(bounds, first, side="right") - 1
    return owner, first, size, digest, bounds, starts, ends


def _key():
    """Rows of one doc_id with different texts are different documents."""
    return F.shiftleft(F.xxhash64("text"), 32)


def _emit(p: SubstringDedup):
    def emit(batches):
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(2)):
                owner, first, _, digest, bounds, _, _ = _chunks(texts, p)
                if len(owner):
                    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    at = pa.array(owner + i)
                    key = np.array(batch.column(1).to_numpy()[owner + i]) + nth
                    yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), batch.column(0).take(at), pa.array(key)], ["digest", "doc_id", "spot"])

    return emit


def _erase(p: SubstringDedup):
    def erase(batches):
        for batch in batches:
            twice = batch.column(2)
            for i, j, texts in text_blocks(batch.column(1)):
                owner, first, size, _, bounds, starts, ends = _chunks(texts, p)
                lows = np.searchsorted(owner, np.arange(j - i + 1))
                out, gone_words, spans = [], [], []
                for n, text in enumerate(texts):
                    cut, gone = [], 0
                    if twice[i + n].is_valid:
                        flag = np.zeros(lows[n + 1] - lows[n] + 2, np.int8)
                        flag[np.asarray(twice[i + n].values) + 1] = 1
                        edge = np.flatnonzero(np.diff(flag)) + lows[n]
                        raw = text.encode("utf-8", "surrogatepass")
                        for a, b in zip(edge[::2], edge[1::2]):
                            w0, w1 = first[a], first[b - 1] + size[b - 1]
                            if w1 - w0 >= p.min_words:
                                cut.append((int(starts[w0]), int(starts[w1] if w1 < bounds[n + 1] else len(raw))))
                                gone += int(w1 - w0)
                        at, rest = 0, []
                        for a, b in cut:
                            rest.append(raw[at:a])
                            at = b
                        text = b"".join([*rest, raw[at:]]).decode("utf-8", "surrogatepass") if cut else text
                    out.append(text)
                    gone_words.append(gone)
                    spans.append([{"start": a, "stop": b} for a, b in cut])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in range(3, batch.num_columns)), pa.array(out, pa.string()), pa.array(np.diff(bounds)), pa.array(gone_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=[*batch.schema.names[3:], "text", "n_words", "n_gone", "gone"],
                )

    return erase


def _shortened(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """row (all columns but the text), text, n_words, n_gone, gone of every row."""
    rest = [c for c, name in zip(columns_of(docs), docs.columns) if name != "text"]
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    chunks = docs.select(last.alias("doc_id"), _key().alias("k"), "text").mapInArrow(_emit(p), "digest long, doc_id long, spot long")
    owners = chunks.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", F.col("lo").alias("owner"))
    owners = saved(owners, "chunk-owners")
    again = chunks.join(owners, "digest").where("doc_id <> owner").select("doc_id", F.expr("spot >> 32 << 32").alias("k"), F.expr("cast(spot & 4294967295L as int)").alias("nth"))
    again = saved(again.groupBy("doc_id", "k").agg(F.collect_set("nth").alias("nths")), "chunks-again")
    left = docs.select(last.alias("__id"), _key().alias("__k"), F.struct(*rest).alias("row"), "text")
    joined = left.join(again, (F.col("__id") == F.col("doc_id")) & (F.col("__k") == F.col("k")), "left")
    span = StructType([StructField("start", LongType()), StructField("stop", LongType())])
    out = StructType([StructField("row", left.schema["row"].dataType), StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_gone", LongType()), StructField("gone", ArrayType(span))])
    return joined.select("__id", "text", "nths", "row").mapInArrow(_erase(p), out)


def substring_dedup(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """``docs`` with ``text`` shortened, and n_words (before), n_gone, gone (byte spans taken out).

    Null and empty texts stay as they are. Rows with one doc_id and one text are one document. A
    null doc_id counts as the largest. Other columns pass through; ones named n_words, n_gone or
    gone are replaced.
    """
    docs = docs.drop("n_words", "n_gone", "gone")
    return _shortened(docs, p).select("row.*", "text", "n_words", "n_gone", "gone").select(*columns_of(docs), "n_words", "n_gone", "gone")


def deduplicated(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """``docs`` with ``text`` shortened as by ``substring_dedup`` and every other column as it was, whatever its name."""
    return _shortened(docs, p).select("row.*", "text").select(*columns_of(docs))
