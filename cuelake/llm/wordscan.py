"""Vectorised scan of white-space separated words: one 64-bit hash a word, without a Python loop.

Words are runs of bytes other than space and 0x09-0x0D in the UTF-8 text; A-Z is lower-cased first.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

#: Bytes looked at together; a word longer than that is looked at whole.
SLICE = 1 << 20

_FOLD = bytes(
    32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
KEEP_CASE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: Letters, digits and bytes beyond ASCII make words; A-Z is lower-cased.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse mod 2**64, for n places."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 2 * SLICE:
        _POWERS[:] = out
    return out


def _edges(part: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    word = part != 32
    if kinds is None:
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        return edge[::2], edge[1::2]
    kind = kinds[part]
    begin = word & ~np.concatenate([[False], word[:-1]])
    begin[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    last = word & np.concatenate([begin[1:] | ~word[1:], [True]])
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _hash_slice(part: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A polynomial of each word's bytes, from one running sum over the slice."""
    start, end = _edges(part, kinds)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = _powers(max(len(part), SLICE))
    total = np.zeros(len(part) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def scan(texts: list[str | None], fold: bytes = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and, last, the number of words)."""
    hashes, bounds, _, _ = scan_spans(texts, fold)
    return hashes, bounds


def scan_spans(texts: list[str | None], fold: bytes = _FOLD, kinds: np.ndarray | None = None):
    """As ``scan``, with each word's first byte and the byte after it, counted from its text's start.

    With ``kinds`` words also end where a byte of kind 1 is followed by one of kind 2.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.frombuffer((b" ".join(raw) + b" ").translate(fold), np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        stop = at + SLICE
        if stop < len(data):
            while stop < len(data) and not (spaces := np.flatnonzero(data[at:stop] == 32)).size:
                stop += SLICE
            stop = at + int(spaces[-1]) + 1 if stop < len(data) else len(data)
        h, s, e = _hash_slice(data[at:stop], kinds)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    e = np.concatenate(ends) if ends else np.empty(0, np.int64)
    bounds = np.searchsorted(s, begins)
    origin = np.repeat(begins[:-1], np.diff(bounds))
    return h, bounds, s - origin, e - origin


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; shorter texts give their whole sequence as one."""
    words, bounds = scan(texts)
    out = []
    if len(words) >= k:
        with np.errstate(over="ignore"):
            rolled = words[: len(words) - k + 1].copy()
            for j in range(1, k):
                rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    else:
        rolled = np.empty(0, np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(np.atleast_1d(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def blocks(values: list, size, limit: int):
    """Index ranges of ``values`` whose sizes sum to about ``limit`` (one value at least)."""
    start, total = 0, 0
    for i, v in enumerate(values):
        n = size(v)
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def text_blocks(column, limit: int = 1 << 20):
    """(first, end, texts) of runs of a batch's rows whose texts have about ``limit`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, j in blocks(sizes, lambda n: int(n) + 1, limit):
        yield i, j, column.slice(i, j - i).to_pylist()
