"""Token counts at every prefix of a text by dynamic programming over byte pairs.

A byte-pair encoding is the one sequence of tokens in which every neighbouring pair is stable: no
merge would cross their border before both are made. So the encoding of a prefix is that of a shorter
prefix and one token more, the one that ends here and is stable after that prefix's last token. The
pass keeps, for every prefix, its last token and its count, both as it stands inside a word and as it
stands when the text ends there (last tokens then carry the end-of-word mark). A text's table is the
running sum of its words' counts and, within a word, the word's own table, so that the count of any
prefix, the longest prefix within a budget and the cut for a truncation are looked up and nothing is
encoded again.

Each distinct word's table is made once in a worker; all words of a block go through the pass together.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import _KINDS
from .wordscan import scan_spans, text_blocks


@dataclass(frozen=True)
class TokenCounts:
    """vocabulary: a file of the tokenizers library, byte-level pairs with an end-of-word mark.

    limit: the budget that ``over_limit`` and ``fits_chars`` ask about.
    words: how many words' tables a worker remembers before it starts afresh.
    """

    vocabulary: str = ""
    limit: int = 2048
    words: int = 400_000


_NONE = np.int64(1 << 40)


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The pass over words given as bytes. Numbers: a byte, 256 more if it ends a word, 512 and a merge's rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        mark, signs = model["end_of_word_suffix"], _byte_signs()
        number = {c: b for c, b in signs.items()} | {c + mark: 256 + b for c, b in signs.items()}
        spelt = [bytes([b]) for b in range(256)] * 2
        left, right = list(range(512)), list(range(512))
        for rank, pair in enumerate(model["merges"]):
            a, b = (number[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            number["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] = 512 + rank
            left.append(a)
            right.append(b)
            spelt.append(spelt[a] + spelt[b])
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        merged = np.arange(512, len(left), dtype=np.int64)
        keys = self.left[512:] << 20 | self.right[512:]
        at = np.argsort(keys)
        self.pairs, self.ranks = keys[at], merged[at]
        # a token that its own bytes do not encode to never occurs
        alone = np.ones(len(left), bool)
        alone[512:] = self.stable(self.left[512:], self.right[512:], merged)
        for t in merged.tolist():
            alone[t] &= alone[left[t]] and alone[right[t]]
        self._trie([(spelt[t], t) for t in np.flatnonzero(alone).tolist()], mark, number)

    def _trie(self, tokens: list[tuple[bytes, int]], mark: str, number: dict[str, int]) -> None:
        ends = np.zeros(len(self.left), bool)
        ends[[t for s, t in number.items() if s.endswith(mark)]] = True
        steps, inside, closing = {}, [-1], [-1]
        for spelling, t in tokens:
            node = 0
            for b in reversed(spelling):
                node = steps.setdefault(node << 8 | b, len(inside))
                if node == len(inside):
                    inside.append(-1)
                    closing.append(-1)
            (closing if ends[t] else inside)[node] = t
        self.inside, self.closing = np.array(inside, np.int64), np.array(closing, np.int64)
        edges = np.array(sorted(steps), np.int64)
        self.edges, self.to = edges, np.array([steps[k] for k in edges.tolist()], np.int64)

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (below ``limit``) crosses between tokens a and b before both are made.

        The pieces that face each other at the border are taken back in the order of their making, the
        last merge first; at each state the pair's own merge must come no sooner than what follows it.
        """
        good = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), _NONE) if limit is None else limit.astype(np.int64)
        while len(at):
            keys = x << 20 | y
            i = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            crossed = (self.pairs[i] == keys) & (self.ranks[i] < bound)
            good[at[crossed]] = False
            # the later one is taken back; single bytes cannot be
            back_x = np.where(x < 512, False, (x > y) | (y < 512))
            back_y = ~back_x & (y >= 512)
            bound = np.where(back_x, x, y + 1)
            x, y = np.where(back_x, self.right[x], x), np.where(back_y, self.left[y], y)
            go = ~crossed & (back_x | back_y)
            at, x, y, bound = at[go], x[go], y[go], bound[go]
        return good

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each prefix as a word of its own, all words' one after the other; where each begins)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        last, tokens, closed = (np.full(len(data), -1, np.int64) for _ in range(3))
        order = np.argsort(-size, kind="stable")
        sizes = -size[order]
        for i in range(int(size.max(initial=0))):
            here = begin[order[: np.searchsorted(sizes, -i, "left")]] + i  # the words with more than i bytes
            node, back = np.zeros(len(here), np.int64), 0
            while len(here):
                keys = node << 8 | data[here - back]
                k = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
                found = self.edges[k] == keys
                here, node = here[found], self.to[k[found]]
                back += 1
                for token, count, keep in ((self.inside[node], tokens, last), (self.closing[node], closed, None)):
                    w = np.flatnonzero((token >= 0) & (count[here] < 0))
                    if back <= i and len(w):
                        w = w[self.stable(last[here[w] - back], token[w])]
                    count[here[w]] = tokens[here[w] - back] + 1 if back <= i else 1
                    if keep is not None:
                        keep[here[w]] = token[w]
                if back > i:
                    break
                more = (tokens[here] < 0) | (closed[here] < 0)
                here, node = here[more], node[more]
        return closed, begin


class WordTables:
    """Prefix tables of words (runs without ASCII white space), each distinct one made once."""

    def __init__(self, p: TokenCounts):
        from tokenizers import Tokenizer

        self.library, self.pass_, self.limit = Tokenizer.from_file(p.vocabulary), PrefixCounter(p.vocabulary), p.words
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size, self.total, self.least = (np.empty(1 << 12, np.int64) for _ in range(4))

    def _learn(self, keys: list[int], words: list[str]) -> None:
        tables = self.tables(words)
        size = np.fromiter(map(len, tables), np.int64, len(tables))
        flat = np.concatenate(tables)
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(keys) > len(self.start):
            self.start, self.size, self.total, self.least = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size, self.total, self.least))
        self.flat[self.used : self.used + len(flat)] = flat
        stop, new = np.cumsum(size), slice(n, n + len(keys))
        self.start[new], self.size[new] = self.used + stop - size, size
        self.total[new], self.least[new] = flat[stop - 1], np.minimum.reduceat(flat, stop - size)
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys))))

    def tables(self, words: list[str]) -> list[np.ndarray]:
        """Tokens of every prefix of each word, by code points."""
        pieces, plans, odd = [], [], {}
        for i, word in enumerate(words):
            if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:  # Latin letters, each with one small one
                plans.append(([(len(pieces), 0)], None))
                pieces.append(word.lower().encode())
                continue
            spelt = self.library.normalizer.normalize_str(word)
            widths = None if len(spelt) == len(word) and word.isascii() else [len(self.library.normalizer.normalize_str(c)) for c in word]
            if widths and "".join(map(self.library.normalizer.normalize_str, word)) != spelt:
                odd[i] = word  # signs that join with one before them: no prefix follows from another
                plans.append(None)
                continue
            cuts = []
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(spelt):
                cuts.append((len(pieces), a))
                pieces.append(spelt[a:b].encode())
            plans.append((cuts, (spelt, widths)))
        closed, begin = self.pass_.counts(pieces)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.append(raw[1:] & 0xC0 != 0x80, True)[: len(raw)]
        closed, begin = closed[ends].astype(np.int32), np.concatenate([[0], np.cumsum(ends)])[begin].tolist()
        out = []
        for i, plan in enumerate(plans):
            if plan is None:
                word = odd[i]
                prefixes = [word[: k + 1] for k in range(len(word))]
                out.append(np.array([len(e.ids) for e in self.library.encode_batch_fast(prefixes, add_special_tokens=False)], np.int32))
                continue
            cuts, spelt = plan
            if spelt is None:
                out.append(closed[begin[cuts[0][0]] : begin[cuts[0][0] + 1]])
                continue
            spelt, widths = spelt
            table, before = np.zeros(len(spelt), np.int64), 0
            for k, a in cuts:
                inner = closed[begin[k] : begin[k + 1]]
                if len(pieces[k]) == 3 and pieces[k][:1] == b"'" and pieces[k][1:].isalpha():
                    inner = np.array([inner[0], 2, inner[2]])  # half a contraction is an apostrophe and a letter
                table[a : a + len(inner)] = before + inner
                before += int(inner[-1])
                table[a + len(inner) :] = before
            if widths:
                at = np.cumsum(widths)
                table = np.where(at > 0, table[np.maximum(at, 1) - 1], 0)
            out.append(table.astype(np.int32))
        return out

    def spans(self, texts: list[str | None]):
        """(number of each word in the tables; where each text's words begin; first and end byte of each word)."""
        if len(self.known) > self.limit:
            self._clear()
        hashes, bounds, starts, ends = scan_spans(texts, kinds=_KINDS)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        at = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        new = new[np.argsort(first[new])]  # text by text
        if len(new):
            owner, raw, held, words = np.searchsorted(bounds, first[new], side="right") - 1, b"", -1, []
            for w, o in zip(first[new].tolist(), owner.tolist()):
                if o != held:
                    raw, held = texts[o].encode("utf-8", "surrogatepass"), o
                words.append(raw[starts[w] : ends[w]].decode("utf-8", "replace"))
            n = len(self.known)
            self._learn([keys[i] for i in new.tolist()], words)
            at[new] = n + np.arange(len(new))
        return at[inverse], bounds, starts, ends

    def documents(self, texts: list[str | None]) -> list[Prefixes]:
        """Each text's table. A special token's string is one token where it ends and common text before that."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            text, at = text or "", 0
            for m in self.special.finditer(text) if self.special and "<" in text else ():
                parts.append(text[at : m.end() - 1])
                owner.append(i)
                special.append(m.end() - m.start())
                at = m.end()
            parts.append(text[at:])
            owner.append(i)
            special.append(0)
        words, bounds, starts, ends = self.spans(parts)
        per_text: list[list] = [[] for _ in texts]
        for j, i in enumerate(owner):
            lo, hi = bounds[j], bounds[j + 1]
            per_text[i].append((parts[j], words[lo:hi], starts[lo:hi], ends[lo:hi], special[j]))
        return [Prefixes(self, x) for x in per_text]


class Prefixes:
    """A text's words with their places and the tokens before each."""

    def __init__(self, tables: WordTables, parts: list):
        self.tables, self.parts = tables, []
        before, at = 0, 0  # tokens and code points so far
        for text, words, starts, ends, special in parts:
            total = tables.total[words]
            base = before + np.cumsum(total) - total
            part = (at, text, words, starts, ends, base)
            before += int(total.sum())
            at += len(text)
            if special:
                before = self._within(part, len(text) - special + 1) + 1
                at += 1
            self.parts.append((part, bool(special), before))
        self.n_tokens, self.n_chars = before, at

    @staticmethod
    def _points(text: str, where: np.ndarray) -> np.ndarray:
        """Code points before byte offsets."""
        if text.isascii():
            return where
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[where]

    def _within(self, part, chars: int) -> int:
        """Tokens of the first ``chars`` code points of a part, with what stands before the part."""
        _, text, words, starts, _, base = part
        first = self._points(text, starts)
        w = int(np.searchsorted(first, chars)) - 1
        if w < 0:
            return int(base[0]) if len(base) else 0
        inner = min(chars - int(first[w]), int(self.tables.size[words[w]]))
        return int(base[w] + self.tables.flat[self.tables.start[words[w]] + inner - 1])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix with at most so many tokens."""
        for (at, text, words, starts, _, base), special, after in reversed(self.parts):
            if special and after <= budget:
                return self._after(at + len(text) + 1)
            fit = np.flatnonzero(base + self.tables.least[words] <= budget)
            if not len(fit):
                if (int(base[0]) if len(base) else after - special) <= budget:
                    return at + (int(self._points(text, starts[:1])[0]) if len(words) else len(text))
                continue
            w = int(fit[-1])
            table = self.tables.flat[self.tables.start[words[w]] :][: self.tables.size[words[w]]]
            inner = int(np.flatnonzero(base[w] + table <= budget)[-1]) + 1
            first = self._points(text, starts[w : w + 2])
            if inner < len(table):
                return at + int(first[0]) + inner
            return at + (int(first[1]) if len(first) > 1 else len(text))  # with the white space after it
        return 0

    def _after(self, at: int) -> int:
        for (start, text, words, starts, _, _), _, _ in self.parts:
            if start == at:
                return at + (int(self._points(text, starts[:1])[0]) if len(words) else len(text))
        return at

    def table(self) -> np.ndarray:
        """Tokens of every prefix: n_chars + 1 numbers, the first 0."""
        out = np.zeros(self.n_chars + 1, np.int32)
        before = 0
        for (at, text, words, starts, _, base), special, after in self.parts:
            here = out[at + 1 : at + 1 + len(text)]
            here[:] = before
            for w, a, b in zip(words.tolist(), self._points(text, starts).tolist(), base.tolist()):
                n = int(self.tables.size[w])
                here[a : a + n] = b + self.tables.flat[self.tables.start[w] :][:n]
                here[a + n :] = b + self.tables.total[w]
            if special:
                out[at + len(text) + 1] = after
            before = after
        return out


@functools.lru_cache(maxsize=1)
def word_tables(p: TokenCounts) -> WordTables:
    """One for each worker process, so that later tasks know the words of earlier ones."""
    return WordTables(p)


def _each_text(p: TokenCounts, schema: pa.Schema, row):
    def run(batches):
        tables = word_tables(p)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1), 2 << 20):
                rows = [row(text, found) for text, found in zip(texts, tables.documents(texts))]
                columns = [batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *schema.names])

    return run


def token_counts(docs: DataFrame, p: TokenCounts) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit, fits_chars of each row of (doc_id, text).

    fits_chars: code points of the longest prefix of at most ``limit`` tokens. A null text counts as
    empty: no bytes, no tokens. Rows that share a doc_id are counted each for itself, a null doc_id
    stays. Other columns are not read. An empty table gives no rows.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fits_chars", pa.int64())])

    def row(text, found):
        return len((text or "").encode("utf-8", "surrogatepass")), found.n_tokens, found.n_tokens > p.limit, found.longest(p.limit)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_each_text(p, schema, row), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def prefix_tables(docs: DataFrame, p: TokenCounts) -> DataFrame:
    """doc_id, prefix_tokens: the tokens of every prefix by code points, from 0 for the empty one.

    Rows as in ``token_counts``. ``tokens_of_prefix``, ``longest_prefix`` and ``truncated`` read it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("prefix_tokens", pa.list_(pa.int32()))])
    return docs.select("doc_id", "text").mapInArrow(_each_text(p, schema, lambda _, found: (found.table(),)), f"doc_id {kind}, prefix_tokens array<int>")


def tokens_of_prefix(table: Column | str, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points (of all, if there are fewer)."""
    table = F.col(table) if isinstance(table, str) else table
    return F.get(table, F.least(F.greatest(chars, F.lit(0)), F.size(table) - 1))


def longest_prefix(table: Column | str, budget: Column) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens; null below 0."""
    table = F.col(table) if isinstance(table, str) else table
    at = F.transform(table, lambda n, i: F.when(n <= budget, i))
    return F.array_max(at)


def truncated(text: Column | str, table: Column | str, budget: Column) -> Column:
    """The longest prefix of the text with at most ``budget`` tokens."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substr(text, F.lit(1), longest_prefix(table, budget))
