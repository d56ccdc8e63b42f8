"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each task packs its own rows, block after block. A block holds as many tokens as its windows hold
but for a few; the last document of a block is cut there. Differencing merges partial partitions
with opposing imbalances into near-equal windows, and a block whose fullest window passes the
capacity is done again with one window more. What a task has left at its end, less than a window,
goes into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import scan_spans, text_blocks


@dataclass(frozen=True)
class Packing:
    """capacity: tokens a window. windows: windows a block. slack: tokens left free in a window.

    crumbs: the last tokens of a block are cut into pieces of these sizes, one of each a window;
    differencing places them last, which evens the windows out. Where the first sizes do not bring
    all windows within the capacity, the next are tried before there is a window more.
    words: how many words' ids a worker remembers before it starts afresh.
    """

    vocabulary: str = ""
    end_id: int = 2
    capacity: int = 4096
    windows: int = 32
    slack: int = 6
    crumbs: tuple[tuple[int, ...], ...] = ((32, 16, 8), (256, 128, 64, 32, 16, 8))
    words: int = 800_000


#: 1: ASCII letters, 2: ASCII signs; the splitter always parts a letter from a sign after it.
_KINDS = np.array([1 if chr(b).isalpha() else 2 if 32 < b < 127 and not chr(b).isalnum() else 0 for b in range(128)] + [0] * 128, np.uint8)


class WordTokenizer:
    """Ids of whole texts, each distinct word being encoded once.

    The vocabulary's normaliser and splitter drop white space, never join what ASCII white space
    separates or an ASCII letter with a sign after it, and fold A-Z, so a text's ids are its words'
    ids one after the other. Texts that may hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encode, self.limit = Tokenizer.from_file(path).encode_batch_fast, limit
        self._clear()

    def _clear(self):
        self.known, self.ids = {}, np.empty(1 << 16, np.uint32)
        self.start, self.size, self.used = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0

    def _learn(self, keys: list[int], words: list[str]):
        for i in range(0, len(words), 4096):
            got = [e.ids for e in self.encode(words[i : i + 4096], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
            n = len(self.known)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while n + len(got) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[n : n + len(got)] = self.used + np.cumsum(size) - size
            self.size[n : n + len(got)] = size
            self.used += len(flat)
            self.known.update(zip(keys[i : i + 4096], range(n, n + len(got))))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self._clear()
        whole = {i: t for i, t in enumerate(texts) if t and "<|" in t}
        plain = ["" if i in whole else t for i, t in enumerate(texts)] if whole else texts
        out = self._by_word(plain)
        for i, t in whole.items():
            out[i] = np.array(self.encode([t], add_special_tokens=False)[0].ids, np.uint32)
        return out

    def _by_word(self, texts: list[str | None]) -> list[np.ndarray]:
        hashes, bounds, starts, ends = scan_spans(texts, kinds=_KINDS)
        if not len(hashes):
            return [np.empty(0, np.uint32)] * len(texts)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        at = list(map(self.known.get, keys))
        new = [i for i, k in enumerate(at) if k is None]
        if new:
            new.sort(key=first.__getitem__)  # text by text
            owner, raw, held = np.searchsorted(bounds, first[new], side="right") - 1, b"", -1
            words = []
            for w, o in zip(first[new].tolist(), owner.tolist()):
                if o != held:
                    raw, held = texts[o].encode("utf-8", "surrogatepass"), o
                words.append(raw[starts[w] : ends[w]].decode("utf-8", "replace"))
            n = len(self.known)
            self._learn([keys[i] for i in new], words)
            for k, i in enumerate(new):
                at[i] = n + k
        at = np.array(at, np.int64)[inverse]
        size = self.size[at].astype(np.int64)
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - (stop - size), size) + np.arange(int(stop[-1]))]
        edge = np.concatenate([[0], stop])[bounds]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]


@functools.lru_cache(maxsize=1)
def tokenizer(path: str, limit: int) -> WordTokenizer:
    """One for each worker process, so that later tasks know the words of earlier ones."""
    return WordTokenizer(path, limit)


def difference(sizes: list[int], k: int) -> tuple[list[int], int]:
    """(window of each item, the largest window's sum) by k-way largest differencing."""
    if k <= 1:
        return [0] * len(sizes), sum(sizes)
    heap, kids = [], {}
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:  # the two most uneven: the fullest of one with the emptiest of the other
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        z = x + y[::-1]
        order = np.argsort(z, kind="stable")
        z = z[order]
        kids[n] = (a, b, order)
        heapq.heappush(heap, (int(z[0] - z[-1]), n, z))
        n += 1
    _, root, z = heap[0]
    out, todo = [0] * len(sizes), [(root, np.arange(k))]
    while todo:
        node, names = todo.pop()
        if node < len(sizes):
            out[node] = int(names[-1])
            continue
        a, b, order = kids[node]
        at = np.empty(k, np.int64)
        at[order] = names
        todo += [(a, at), (b, at[::-1])]
    return out, int(z[-1])


def _packer(p: Packing):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(batches):
        pa.default_memory_pool().release_unused()  # what earlier stages left to this worker
        encode, sequence = tokenizer(p.vocabulary, p.words), TaskContext.get().partitionId() << 36
        waiting, held, rows = [], 0, []  # pieces: (doc_id, start, ids, doc_tokens)
        most = p.windows * (p.capacity - p.slack)

        def put(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def cut(pieces, n):
            """The pieces' first n tokens, and the rest."""
            head, i = [], 0
            while n and i < len(pieces):
                doc, start, ids, total = pieces[i]
                head.append((doc, start, ids[:n], total))
                if len(ids) > n:
                    return head, [(doc, start + n, ids[n:], total), *pieces[i + 1 :]]
                n -= len(ids)
                i += 1
            return head, pieces[i:]

        def spread(pieces, k):
            if not k:
                return
            total = sum(len(x[2]) for x in pieces)
            for crumbs in p.crumbs:
                fine, rest = cut(pieces, total - k * sum(crumbs) if k > 1 else total)
                for size in [c for c in crumbs for _ in range(k)]:
                    crumb, rest = cut(rest, size)
                    fine += crumb
                sizes = [len(x[2]) for x in fine]
                window, fullest = difference(sizes, k)
                if fullest <= p.capacity:
                    break
            while fullest > p.capacity:
                k += 1
                window, fullest = difference(sizes, k)
            packed = [[] for _ in range(k)]
            for w, x in zip(window, fine):
                packed[w].append(x)
            for x in packed:
                if x:
                    put(x)

        def full():
            nonlocal rows
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, texts in text_blocks(batch.column(1), 1 << 20):
                for doc, tokens in zip(ids[i:j], encode(texts)):
                    tokens = np.append(tokens, np.uint32(p.end_id))
                    total, at = len(tokens), 0
                    while total - at > p.capacity:
                        put([(doc, at, tokens[at : at + p.capacity], total)])
                        at += p.capacity
                    waiting.append((doc, at, tokens[at:], total))
                    held += total - at
                    if held >= most:
                        head, waiting = cut(waiting, most)
                        held -= most
                        spread(head, p.windows)
                if rows:
                    yield full()
        k = held // (p.capacity - p.slack)
        head, waiting = cut(waiting, k * (p.capacity - p.slack))
        spread(head, k)
        held -= k * (p.capacity - p.slack)
        for bit in reversed(range(held.bit_length())):
            if held >> bit & 1:
                head, waiting = cut(waiting, 1 << bit)
                put(head)
        if rows:
            yield full()

    return pack


def packed(docs: DataFrame, p: Packing) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A row a piece. Null texts count as empty and give the closing id alone. Rows with one doc_id are
    packed each for itself. An empty table gives no rows. Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _packer(p), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
