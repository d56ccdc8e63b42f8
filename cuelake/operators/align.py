"""Order-preserving fuzzy joins of two sequences, and what follows from their edit scripts."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.text import indel
from .sequence import dealt, together

# Fixed values of the alignment's scores, bands and budget.
LIKE, LIKE_SCORE, UNLIKE, GAP = 0.85, 2.0, -0.6, -0.75
MARGINS, CELLS = (64, 256, 1024), 2_000_000
BONUS, LEAST_RADIUS = 0.2, 2.0
DELETE, INSERT, PAIR = 1, 2, 3

#: Scores are whole numbers of this part of 1, so that equal scores are equal whatever their order of addition.
UNIT = 20 * 2**24
GAP_UNITS, UNLIKE_UNITS, NEVER = round(GAP * UNIT), round(UNLIKE * UNIT), -(2**60)
#: Cells whose steps are kept at once; larger parts are halved.
HELD = 1 << 24
#: Short episodes that are aligned side by side, and rows that are looked at together.
TOGETHER, AT_ONCE = 512, 2048
#: Longer ones that are: cells of one at most, cells of all and their number; from how many these are chosen.
ALONE, ABREAST, WIDE, MANY = 1 << 21, 1 << 24, 32, 256
#: Tokens of such episodes that are held at once; a longer one is held alone.
TOKENS = 1 << 18

def unique_exact_pairs(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Tokens that stand once on either side; none at all unless their order agrees."""
    one = lambda seq: {t: i for i, t in enumerate(seq) if t and n[t] == 1}
    n = Counter(left)
    a = one(left)
    n = Counter(right)
    b = one(right)
    pairs = sorted((i, b[t]) for t, i in a.items() if t in b)
    return pairs if all(x[1] < y[1] for x, y in zip(pairs, pairs[1:])) else []


def bands(n: int, m: int, margin: int, centres: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For rows 0..n the disjoint column ranges that are worked out: the diagonal and the centres."""
    if not n:
        return [[(0, m)]]
    extra: dict[int, list[int]] = {}
    for i, j in centres:
        extra.setdefault(i, []).append(j)
        extra.setdefault(i + 1, []).append(j + 1)
    out = []
    for i in range(n + 1):
        spots = [round(i * m / n), *extra.get(i, ())]
        spots += [0] if i == 0 else [m] if i == n else []
        merged: list[list[int]] = []
        for lo, hi in sorted((max(0, s - margin), min(m, s + margin)) for s in spots):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out.append([(a, b) for a, b in merged])
    return out


class Scores:
    """What pairing left token i with each right token of a range is worth, a row at a time.

    Each different left token is compared with the different right tokens once, and only with those
    whose letters allow a ratio of ``LIKE``. ``priors`` are (expected time, radius) of left tokens and
    the times of right ones: like pairs near their expected time score up to ``BONUS`` more.
    """

    def __init__(self, left: list[str], right: list[str], priors=None):
        names = sorted(set(right))
        number = {t: k for k, t in enumerate(names)}
        self.left, self.right, self.priors = left, right, priors
        self.ids = np.array([number[t] for t in right], np.int64)
        self.worth = np.full(len(names), UNLIKE_UNITS, np.int64)
        self.names, self.number = names, number
        self.bags, self.sizes = self._bags(names), np.array([len(t) for t in names], np.int64)
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _bags(names: list[str]) -> np.ndarray:
        letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
        at = np.repeat(np.arange(len(names)), [len(t) for t in names])
        return np.bincount(at * 64 + letters, minlength=64 * len(names)).reshape(-1, 64)

    def like(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of right tokens that are like ``token``, their scores)."""
        if token not in self.known:
            found = []
            if token and len(self.names):
                apart = np.abs(self.bags - self._bags([token])[0]).sum(axis=1)  # never more than letters to add or remove
                near = apart <= (1 - LIKE) * (self.sizes + len(token)) + 1e-9
                for k in np.flatnonzero(near & (self.sizes > 0)):
                    ratio = 1.0 if self.names[k] == token else indel(token, self.names[k]) / 100
                    if ratio >= LIKE:
                        found.append((k, round(LIKE_SCORE * ratio * UNIT)))
            self.known[token] = (np.array([k for k, _ in found], np.int64), np.array([s for _, s in found], np.int64))
        return self.known[token]

    def row(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Scores of left token i with right tokens lo..hi-1."""
        ids, scores = self.like(self.left[i])
        self.worth[ids] = scores
        out = self.worth[self.ids[lo:hi]]
        self.worth[ids] = UNLIKE_UNITS
        if self.priors is not None and len(ids):
            expected, radius, times = self.priors
            away = np.abs(times[lo:hi] - expected[i]) / radius[i]
            out = out + np.where((out != UNLIKE_UNITS) & (away < 1), np.rint(BONUS * UNIT * (1 - np.minimum(away, 1))).astype(np.int64), 0)
        return out


def _down(scores: Scores, above: np.ndarray, i: int, base: int, ranges, gaps: np.ndarray, left0: int):
    """The row after ``above`` (columns base..base+len-1) and, by range, the step that reaches each cell.

    Among equal scores delete comes before insert before pair; inserts run along a range, so their
    best start is a running maximum.
    """
    now, how = np.full(len(above), NEVER, np.int64), []
    for lo, hi in ranges:
        a, b = lo - base, hi - base + 1
        down = above[a:b] + GAP_UNITS
        pair = np.full(b - a, NEVER, np.int64)
        first = max(lo, base + 1)
        if first <= hi:
            pair[first - lo :] = above[first - 1 - base : hi - base] + scores.row(left0 + i - 1, first - 1, hi)
        best = np.maximum(down, pair)
        run = np.maximum.accumulate(best - gaps[: b - a]) + gaps[: b - a]
        kind = np.where(run == down, DELETE, np.where(run > best, INSERT, PAIR)).astype(np.uint8)
        insert = np.zeros(b - a, bool)
        insert[1:] = run[:-1] + GAP_UNITS == run[1:]
        kind[(kind == PAIR) & insert] = INSERT
        dead = run <= NEVER // 2
        now[a:b] = np.where(dead, NEVER, run)
        kind[dead] = 0
        how.append((lo, kind))
    return now, how


def _fill(scores: Scores, rows, left0: int = 0, right0: int = 0, m: int | None = None):
    """Steps (kind, i, j) of the best script within the bands of ``rows``; None if they don't reach the end.

    Columns are counted from ``right0`` in the scores, rows from ``left0``; ``rows`` are absolute columns.
    """
    m = len(scores.right) if m is None else m
    base, n = right0, len(rows) - 1
    gaps = np.arange(m + 1, dtype=np.int64) * GAP_UNITS
    above, step = np.full(m + 1, NEVER, np.int64), []
    first = []
    for lo, hi in rows[0]:
        kind = np.zeros(hi - lo + 1, np.uint8)
        if lo == base:
            above[: hi - base + 1], kind[1:] = gaps[: hi - base + 1], INSERT
        first.append((lo, kind))
    step.append(first)
    for i in range(1, n + 1):
        above, how = _down(scores, above, i, base, rows[i], gaps, left0)
        step.append(how)
    if above[m] == NEVER:
        return None
    out, i, j = [], n, base + m
    while i or j > base:
        kind = next(kinds[j - lo] for lo, kinds in step[i] if lo <= j < lo + len(kinds))
        i, j = i - (kind != INSERT), j - (kind != DELETE)
        out.append((int(kind), left0 + i, j))
    return out[::-1]


def _exact(scores: Scores, a: int, b: int, c: int, d: int) -> list[tuple[int, int, int]]:
    """Steps of a best script of left[a:b] and right[c:d], over all cells; large parts are halved."""
    n, m = b - a, d - c
    if not n or not m or n * m <= HELD:
        return _fill(scores, [[(c, d)]] * (n + 1), a, c, m)
    if n == 1:
        return _fill(scores, [[(c, d)]] * 2, a, c, m)
    half, gaps = n // 2, np.arange(m + 1, dtype=np.int64) * GAP_UNITS
    row = gaps.copy()
    for i in range(1, half + 1):
        row, _ = _down(scores, row, i, c, [(c, d)], gaps, a)
    up = gaps.copy()
    for i in range(n - 1, half - 1, -1):  # from the end: best score of the rest, by column
        pair = np.full(m + 1, NEVER, np.int64)
        pair[1:] = up[:-1] + scores.row(a + i, c, d)[::-1]
        best = np.maximum(up + GAP_UNITS, pair)
        up = np.maximum.accumulate(best - gaps) + gaps
    j = c + int(np.argmax(row + up[::-1]))
    return _exact(scores, a, a + half, c, j) + _exact(scores, a + half, b, j, d)


def edit_script(left: list[str], right: list[str]) -> list[tuple[str, int | None, int | None, float]]:
    """The operations of ``scripted`` alone."""
    return scripted(left, right)[0]


def scripted(left: list[str], right: list[str], priors=None) -> tuple[list[tuple[str, int | None, int | None, float]], bool]:
    """(operations in order: match, replace, delete (left only), insert (right only); whether bands fell short).

    A like pair scores as one but is a match only if both are the same. Among equal scores delete
    comes before insert before match. Bands widen until all unique exact pairs are matched. Where the
    budget of cells ends before, both sequences are cut at these pairs and each part is aligned over
    all of its cells, so no match is given up.
    """
    steps, limited = _steps(left, right, priors)
    return [_operation(left, right, *s) for s in steps], limited


def _steps(left: list[str], right: list[str], priors=None) -> tuple[list[tuple[int, int, int]], bool]:
    n, m = len(left), len(right)
    pairs = unique_exact_pairs(left, right)
    scores = Scores(left, right, priors)
    centres = pairs
    if priors is not None and m:
        centres = pairs + list(enumerate(_nearest(priors).tolist()))
    room, steps = CELLS, None
    for margin in dict.fromkeys(min(x, max(n, m)) for x in MARGINS):
        rows = bands(n, m, margin, centres)
        cells = sum(b - a + 1 for r in rows for a, b in r)
        if cells > room:
            continue
        room -= cells
        got = _fill(scores, rows)
        if got is not None and (margin >= max(n, m) or set(pairs) <= {(i, j) for kind, i, j in got if kind == PAIR}):
            steps = got
            break
    limited = steps is None
    if limited:
        steps, a, c = [], 0, 0
        for i, j in [*pairs, (n, m)]:
            steps += _exact(scores, a, i, c, j)
            if i < n:
                steps.append((PAIR, i, j))
            a, c = i + 1, j + 1
    return steps, limited


def _nearest(priors) -> np.ndarray:
    """By left token the right one nearest to its expected time, the earlier among equals."""
    expected, _, times = priors
    after = np.clip(np.searchsorted(times, expected), 1, max(len(times) - 1, 1))
    here = np.minimum(after, len(times) - 1)
    return np.where(np.abs(times[after - 1] - expected) <= np.abs(times[here] - expected), after - 1, here)


def _operation(left: list[str], right: list[str], kind: int, i: int, j: int) -> tuple[str, int | None, int | None, float]:
    if kind == DELETE:
        return "delete", i, None, 0.0
    if kind == INSERT:
        return "insert", None, j, 0.0
    x, y = left[i], right[j]
    same = x == y and x != ""
    return "match" if same else "replace", i, j, 1.0 if same else indel(x, y) / 100

# ---- longer episodes side by side


@functools.lru_cache(1 << 17)
def _ratio(a: str, b: str) -> float:
    return indel(a, b) / 100


def ratio(a: str, b: str) -> float:
    """``indel`` as a share; that of words is remembered, as they come again in other episodes."""
    return _ratio(a, b) if len(a) + len(b) <= 64 else indel(a, b) / 100


def ratios(names: list[str], others: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``ratio`` of names[a] and others[b], 1 if they are the same: letters in common by bits, all pairs at once."""
    size = [np.array([len(t) for t in x], np.int64) for x in (names, others)]
    n, m = size[0][a], size[1][b]
    out = np.empty(len(a))
    small = (n <= 60) & (m <= 60)
    for k in np.flatnonzero(~small).tolist():
        s, t = names[a[k]], others[b[k]]
        out[k] = 1.0 if s == t else ratio(s, t)
    which = np.flatnonzero(small)
    if len(which):
        a, b, n, m = a[which], b[which], n[which], m[which]
        x, y = _letters_of(names, size[0], int(n.max()), 0)[a], _letters_of(others, size[1], int(m.max()), 1)[b]
        bit, full = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64), (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        s = full.copy()
        for k in range(y.shape[1]):
            u = s & (x == y[:, k : k + 1]) @ bit
            s = ((s + u) | (s - u)) & full
        out[which] = 200.0 * (n - np.bitwise_count(s)) / (n + m) / 100
    return out


def _letters_of(names: list[str], size: np.ndarray, wide: int, none: int) -> np.ndarray:
    """Names as rows of letters, the first ``wide`` of each; ``none`` and more where they end is no letter."""
    out = np.full((len(names), wide), 0x110000 + none, np.uint32)
    letters, short = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), np.minimum(size, wide)
    out[np.repeat(np.arange(len(names)), short), _ranges(np.zeros(len(names), np.int64), short)] = letters[_ranges(np.cumsum(size) - size, short)]
    return out


def _places(tokens: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where a name's places begin, how many they are, all places by name and order)."""
    number = {t: k for k, t in enumerate(names)}
    ids = np.array([number.get(t, len(names)) for t in tokens], np.int64)
    n = np.bincount(ids, minlength=len(names) + 1)
    return np.cumsum(n) - n, n, np.argsort(ids, kind="stable")


class Sides:
    """Both sides of an episode, what of them is alike, and the priors of their times."""

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right, self.n, self.m = left, right, len(left), len(right)
        self.pairs = unique_exact_pairs(left, right)
        self.priors, self._like = None, None

    def like(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left places, right places, what the pair is worth beyond an unlike one) of like pairs, by left place."""
        if self._like is None:
            self._like = self._alike()
        i, j, more = self._like
        if self.priors is not None:
            expected, radius, times = self.priors
            away = np.abs(times[j] - expected[i]) / radius[i]
            more = more + np.where(away < 1, np.rint(BONUS * UNIT * (1 - np.minimum(away, 1))).astype(np.int64), 0)
        return i, j, more

    def _alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, others = (list(dict.fromkeys(t for t in x if t)) for x in (self.left, self.right))
        (at, n, mine), (at_, m, theirs) = _places(self.left, names), _places(self.right, others)
        size = [np.array([len(t) for t in x], np.int64) for x in (names, others)]
        bags = [Scores._bags(x).astype(np.uint8 if max(size[0].max(initial=0), size[1].max(initial=0)) < 256 else np.int64) for x in (names, others)]
        bits = [np.packbits(x > 0, axis=1).view(np.uint64)[:, 0] for x in bags]
        apart = np.bitwise_count(bits[0][:, None] ^ bits[1][None, :])  # never more than the bags are, nor these than letters to add or remove
        most = (1 - LIKE) * (size[0][:, None] + size[1][None, :]) + 1e-9
        a, b = np.nonzero(apart <= most)
        x, y = bags[0][a], bags[1][b]
        near = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= most[a, b]
        a, b = a[near], b[near]
        alike = ratios(names, others, a, b)
        like = np.flatnonzero(alike >= LIKE)
        a, b, worth = a[like], b[like], np.rint(LIKE_SCORE * alike[like] * UNIT).astype(np.int64) - UNLIKE_UNITS
        # a like pair of words stands for all pairs of their places
        sizes = n[a] * m[b]
        pair, nth = np.repeat(np.arange(len(a)), sizes), _ranges(np.zeros(len(a), np.int64), sizes)
        i, j = mine[at[a][pair] + nth // m[b][pair]], theirs[at_[b][pair] + nth % m[b][pair]]
        order = np.argsort(i, kind="stable")
        return i[order], j[order], worth[pair][order]

    def spots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, columns) of the bands' middles, a row once in each: those of ``bands``."""
        rows = np.arange(self.n + 1)
        yield rows, np.rint(rows * self.m / self.n).astype(np.int64)
        yield np.array([0, self.n]), np.array([0, self.m])
        if self.pairs:
            i, j = np.array(self.pairs).T
            yield i, j
            yield i + 1, j + 1
        if self.priors is not None:
            near = _nearest(self.priors)
            yield rows[:-1], near
            yield rows[1:], near + 1


def scripts(sides: list[Sides]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(steps, left places, right places, limited) of each episode, as ``scripted`` has them.

    Bands are filled side by side; an episode without a side, with very many cells or whose bands fall short goes alone.
    """
    out: list = [None] * len(sides)
    room = [CELLS] * len(sides)
    open_ = [k for k, s in enumerate(sides) if s.n and s.m and (s.n + 1) * (s.m + 2) <= ALONE]
    before: list[int] = [0] * len(sides)
    for widest in MARGINS:
        margins = {k: min(widest, max(sides[k].n, sides[k].m)) for k in open_}
        turn = sorted((k for k in open_ if margins[k] != before[k]), key=lambda k: sides[k].m / sides[k].n)  # bands of like slope lie over each other
        for part in _parts(turn, sides):
            for k, cells, got in zip(part, *_abreast([sides[k] for k in part], [margins[k] for k in part])):
                if cells > room[k]:
                    continue
                room[k] -= cells
                if got is None:
                    continue
                kind, i, j = got
                if margins[k] < max(sides[k].n, sides[k].m):
                    if not set(sides[k].pairs) <= set(zip(i[kind == PAIR].tolist(), j[kind == PAIR].tolist())):
                        continue
                out[k] = (*got, False)
        before = [margins.get(k, b) for k, b in enumerate(before)]
        open_ = [k for k in open_ if out[k] is None]
    for k, s in enumerate(sides):
        if out[k] is None:
            steps, limited = _steps(s.left, s.right, s.priors)
            out[k] = (*(np.array([x[c] for x in steps], np.int64) for c in range(3)), limited)
    return out


def _parts(turn: list[int], sides: list[Sides]) -> Iterator[list[int]]:
    """Up to ``WIDE`` of them at once, by falling length."""
    part: list[int] = []
    for k in turn:
        more = [*part, k]
        if part and (len(more) > WIDE or (max(sides[x].n for x in more) + 1) * (max(sides[x].m for x in more) + 2) * len(more) > ABREAST):
            yield sorted(part, key=lambda x: -sides[x].n)
            more = [k]
        part = more
    if part:
        yield sorted(part, key=lambda x: -sides[x].n)


def _abreast(sides: list[Sides], margins: list[int]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]]:
    """Cells of each one's bands and its script (None if they don't reach the end); the episodes come by falling length.

    A row of all episodes is filled at once. Scores are counted from what gaps alone would have cost up to the
    cell, so a gap leaves them as they are; among equal ones delete comes before insert before pair.
    """
    never, lift, paired_ = -(2**50), 2**52, UNLIKE_UNITS - 2 * GAP_UNITS
    n, m = (np.array([getattr(s, x) for s in sides]) for x in "nm")
    rows, wide = int(n.max()) + 1, int(m.max()) + 2
    off = np.ones((rows, len(sides), wide), bool)
    cells, split, first, last = [], np.zeros(rows, bool), np.full(rows, wide), np.zeros(rows, np.int64)
    for k, (s, margin) in enumerate(zip(sides, margins)):
        own = np.zeros((s.n + 1, s.m + 2), np.int8)
        for r, c in s.spots():
            own[r, np.maximum(c - margin, 0)] += 1
            own[r, np.minimum(c + margin, s.m) + 1] -= 1
        band = np.cumsum(own, axis=1, dtype=np.int8) > 0
        off[: s.n + 1, k, : s.m + 2] = ~band
        cells.append(int(np.count_nonzero(band)))
        split[: s.n + 1] |= np.count_nonzero(band[:, 1:] > band[:, :-1], axis=1) + band[:, 0] > 1
        np.minimum(first[: s.n + 1], band.argmax(axis=1), out=first[: s.n + 1])
        np.maximum(last[: s.n + 1], s.m + 2 - band[:, ::-1].argmax(axis=1), out=last[: s.n + 1])
    first, last = first.tolist(), last.tolist()
    alive = np.searchsorted(-n, -np.arange(rows + 1), side="right").tolist()
    like = [s.like() for s in sides]
    who = np.repeat(np.arange(len(sides)), [len(x[0]) for x in like])
    row, column, more = (np.concatenate([x[c] for x in like]) + (c < 2) for c in range(3))
    order = np.argsort(row, kind="stable")
    who, column, more = who[order], column[order], more[order]
    bounds = np.searchsorted(row[order], np.arange(rows + 1)).tolist()
    above = np.full((len(sides), wide + 1), never, np.int64)  # column j stands at j + 1
    above[:, 1:][np.logical_and.accumulate(~off[0], axis=1)] = 0
    steps = np.full(off.shape, INSERT, np.uint8)
    reached = np.zeros(len(sides), bool)
    for r in range(1, rows):
        a, lo, hi = alive[r], first[r], last[r]
        old, out = above[:a, lo + 1 : hi + 1], off[r, :a, lo:hi]
        best = above[:a, lo:hi] + paired_
        k, c, w = (x[bounds[r] : bounds[r + 1]] for x in (who, column, more))
        inside = (c >= lo) & (c < hi)
        best[k[inside], c[inside] - lo] += w[inside]
        np.maximum(best, old, out=best)
        np.copyto(best, never, where=out)
        if split[r]:  # inserts don't lead from one range to the next
            of = np.zeros(best.shape, np.int64)
            of[:, 1:] = np.cumsum(out[:, :-1] & ~out[:, 1:], axis=1)
            best += of * lift
            np.maximum.accumulate(best, axis=1, out=best)
            best -= of * lift
        else:
            np.maximum.accumulate(best, axis=1, out=best)
        np.copyto(best, never, where=out)
        kind = np.full(best.shape, PAIR, np.uint8)
        np.copyto(kind[:, 1:], INSERT, where=best[:, 1:] == best[:, :-1])
        np.copyto(kind, DELETE, where=best == old)
        steps[r, :a, lo:hi] = kind
        above[:a, first[r - 1] + 1 : last[r - 1] + 1] = never
        above[:a, lo + 1 : hi + 1] = best
        for k in range(alive[r + 1], a):
            reached[k] = above[k, m[k] + 1] > never // 2
    who, kind, i, j = _walked(steps, np.flatnonzero(reached), n, m)
    ends = np.searchsorted(who, np.arange(len(sides) + 1))
    return cells, [(kind[x:y].astype(np.int64), i[x:y], j[x:y]) if ok else None for ok, x, y in zip(reached, ends, ends[1:])]


def _walked(steps: np.ndarray, every: np.ndarray, n: np.ndarray, m: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, ...]:
    """(episode, step, left place, right place) on the way back from each one's end, in order; ``steps`` by row, episode, column or by diagonal, row, episode."""
    i, j, back = n.copy(), m.copy(), []
    while len(every):
        every = every[(i[every] > 0) | (j[every] > 0)]
        kind = steps[i[every] + j[every], i[every], every] if diagonal else steps[i[every], every, j[every]]
        i[every] -= kind != INSERT
        j[every] -= kind != DELETE
        back.append((every, kind, i[every], j[every]))
    who, kind, i, j = (np.concatenate([x[k] for x in back[::-1]] or [np.empty(0, np.int64)]) for k in range(4))
    order = np.argsort(who, kind="stable")
    return who[order], kind[order], i[order], j[order]



def paired(left: DataFrame, right: DataFrame, columns: list[str], fn: Callable[[object, dict, dict], list[tuple]], schema: StructType) -> DataFrame:
    """``fn`` over both sides of each episode, as lists by column in the order of the first: rows of ``schema``.

    One exchange and one sort bring both sides of an episode together; batches hold many episodes.
    """
    def run(batches):
        out: list[tuple] = []
        for key, a, b in _episodes(batches, columns):
            out.extend(fn(key, a, b))
            if len(out) > 50_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return _sides(left, right, columns).mapInArrow(run, schema)


def _sides(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    sides = [d.select("ep", F.lit(k).alias("side"), *columns) for k, d in enumerate((left, right))]
    both = together(sides[0].unionByName(sides[1])).sortWithinPartitions("ep", "side", columns[0])
    return both.select("ep", "side", *columns)


def _episodes(batches, columns: list[str]):
    """(ep, left, right) of rows in order, the sides as lists by column."""
    key, held = None, None
    for batch in batches:
        ep, side = _listed(batch.column("ep")), _listed(batch.column("side"))
        rows = {c: _listed(batch.column(c)) for c in columns}
        at = 0
        for i in _turns(batch):
            if held is None or ep[at] != key:
                if held is not None:
                    yield key, *held
                key, held = ep[at], tuple({c: [] for c in columns} for _ in range(2))
            for c in columns:
                held[side[at]][c].extend(rows[c][at:i])
            at = i
    if held is not None:
        yield key, *held


def _listed(column: pa.Array) -> list:
    """Values as Python objects; by way of numpy, where that keeps them."""
    kept = pa.types.is_string(column.type) or not column.null_count and not pa.types.is_nested(column.type) and not pa.types.is_temporal(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if kept else column.to_pylist()


def _turns(batch: pa.RecordBatch) -> list[int]:
    """Where a side of an episode ends in a batch of rows in order."""
    other = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in ("ep", "side"):
        x = batch.column(c)
        other |= pc.not_equal(x[1:], x[:-1]).fill_null(True).to_numpy(zero_copy_only=False) if len(other) else other
    return [*(np.flatnonzero(other) + 1).tolist(), batch.num_rows] if batch.num_rows else []


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)


def align_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edit scripts of (ep, idx, token) sequences, or of (ep, idx, tokens): pieces, each an array of tokens in order.

    Null tokens count as empty, which is like nothing. ``limited`` tells that the bands of the episode fell short.
    Pieces save a row a token where a text's tokens lie together already.
    """
    schema = _script_schema(left)

    def run(batches):
        for part, found in _coded(batches):
            yield _operations(part, *found, schema)

    return _pieces(left, right).mapInArrow(run, schema)


def aligned_divergences(left: DataFrame, right: DataFrame) -> DataFrame:
    """``divergences`` of ``align_tokens``, and beside them ``before_left``, ``before_right``, ``after_left``, ``after_right``: the places of the matches around.

    An episode's operations lie together where they are made, so its runs are told there and its operations go nowhere.
    """
    schema = _run_schema(left)

    def run(batches):
        for part, found in _coded(batches):
            yield _runs(part, *found, schema)

    return _pieces(left, right).mapInArrow(run, schema)


def _pieces(left: DataFrame, right: DataFrame) -> DataFrame:
    tokens = lambda d: F.col("tokens") if "tokens" in d.columns else F.array("token").alias("tokens")
    return _sides(*(d.select("ep", "idx", tokens(d)) for d in (left, right)), ["idx", "tokens"]).select("ep", "side", "tokens")


class Coded:
    """Whole episodes as numbers: episode k's tokens are ids[at[k] : at[k] + n[k]] to the left, the m[k] after them to the right."""

    def __init__(self, ep: pa.Array, ids: np.ndarray, names: list[str], n: np.ndarray, m: np.ndarray):
        self.ep, self.ids, self.names, self.n, self.m = ep, ids, names, n, m
        self.at = np.cumsum(n + m) - n - m

    @functools.cached_property
    def letters(self) -> np.ndarray:
        return np.array([len(t) for t in self.names], np.int64)

    def part(self, which: np.ndarray) -> Coded:
        sizes = (self.n + self.m)[which]
        return Coded(self.ep.take(pa.array(which)), self.ids[_ranges(self.at[which], sizes)], self.names, self.n[which], self.m[which])

    def sides(self, k: int) -> tuple[list[str], list[str]]:
        got = [self.names[x] for x in self.ids[self.at[k] : self.at[k] + self.n[k] + self.m[k]].tolist()]
        return got[: self.n[k]], got[self.n[k] :]

    def short(self) -> np.ndarray:
        """By episode, whether it is ``short``."""
        size = self.letters[self.ids]
        longest = np.zeros((2, len(self.n)), np.int64)
        who = np.repeat(np.arange(len(self.n)), self.n + self.m)
        np.maximum.at(longest, ((np.arange(len(self.ids)) - self.at[who] >= self.n[who]).astype(np.int64), who), size)
        both = longest.sum(axis=0)
        return (np.maximum(self.n, self.m) <= MARGINS[0]) & (both - 1 < LIKE * both)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _coded(batches) -> Iterator[tuple[Coded, tuple]]:
    """(episodes, their scripts: number of the episode, place, step, left place, right place, limited) of rows in order, some at once."""
    for batch in _whole(batches):
        side, size = batch.column("side").to_numpy(), pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(batch.column("tokens").flatten().fill_null(""))
        ends = np.array([*_changes(batch, ("ep",)), batch.num_rows])
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        n, m = (np.bincount(of[side == k], size[side == k], len(ends)).astype(np.int64) for k in (0, 1))
        every = Coded(batch.column("ep").take(pa.array(ends - 1)), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), n, m)
        few = every.short()
        which = np.flatnonzero(few)
        for k in range(0, len(which), TOGETHER):
            part = every.part(which[k : k + TOGETHER])
            found = short_scripts(part)
            yield part, (*found, np.zeros(len(found[0]), bool))
        which = np.flatnonzero(~few)
        for some in _some(which, (every.n + every.m)[which]):
            part = every.part(some)
            yield from _in_turn(part, scripts([Sides(*part.sides(e)) for e in range(len(part.n))]))


def _some(which: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``MANY`` of them at most, of ``TOKENS`` tokens at most."""
    at = 0
    while at < len(which):
        end = min(at + MANY, at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + MANY]), TOKENS, side="right"))))
        yield which[at:end]
        at = end


def _in_turn(part: Coded, found: list) -> Iterator[tuple[Coded, tuple]]:
    """Scripts of some episodes as ``_coded`` has them, some ten thousand operations at once."""
    at = 0
    while at < len(found):
        end, rows = at, 0
        while end < len(found) and (end == at or rows + len(found[end][0]) <= 50_000):
            rows += len(found[end][0])
            end += 1
        sizes = np.array([len(kind) for kind, *_ in found[at:end]])
        who, (step, i, j) = np.repeat(np.arange(end - at), sizes), (np.concatenate([f[c] for f in found[at:end]]) for c in range(3))
        yield part.part(np.arange(at, end)), (who, _ranges(np.zeros(end - at, np.int64), sizes), step, i, j, np.repeat([f[3] for f in found[at:end]], sizes))
        at = end


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order, cut so that each episode lies in one."""
    held: list[pa.RecordBatch] = []
    for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
        if held and held[-1].column("ep")[-1].as_py() != batch.column("ep")[0].as_py():
            yield pa.concat_batches(held)
            held = []
        last = ([0, *_changes(batch, ("ep",))])[-1]
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[int]:
    """Rows, the first left out, at which one of the columns differs from the row before; a null is one of the values."""
    other = np.zeros(max(batch.num_rows - 1, 0), bool)
    for x in map(batch.column, names):
        if len(other):
            null = x.is_null().to_numpy(zero_copy_only=False)
            other |= pc.not_equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return (np.flatnonzero(other) + 1).tolist()


def short(left: list[str], right: list[str]) -> bool:
    """Whether the narrowest band holds all cells and no two different tokens can be ``LIKE``: one letter apart is too much."""
    longest = max(map(len, left), default=0) + max(map(len, right), default=0)
    return max(len(left), len(right)) <= MARGINS[0] and longest - 1 < LIKE * longest


def short_scripts(episodes: Coded | list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, ...]:
    """(number of the pair, place, step, left place, right place) of the scripts of ``short`` pairs, as ``scripted`` has them.

    All pairs go through the diagonals side by side; what lies beyond a pair's end changes nothing before it.
    Scores are counted from what gaps alone would have cost up to the cell, in the largest unit that holds all.
    """
    p = episodes if isinstance(episodes, Coded) else _listed_pairs(episodes)
    n, m, ids = p.n, p.m, np.where(p.letters[p.ids] > 0, p.ids, -1).astype(np.int32) if len(p.ids) else p.ids.astype(np.int32)
    a, b = np.full((n.max(initial=0), len(n)), -1, np.int32), np.full((m.max(initial=0), len(n)), -2, np.int32)  # what is no token is like nothing
    every = np.arange(len(n))
    for to, at, size in ((a, p.at, n), (b, p.at + n, m)):
        to[_ranges(np.zeros(len(n), np.int64), size), np.repeat(every, size)] = ids[_ranges(at, size)]
    b[b == -1] = -2
    rows, columns = len(a), len(b)
    same, unlike = (np.int16((round(x * UNIT) - 2 * GAP_UNITS) >> 24) for x in (LIKE_SCORE, UNLIKE))
    back = b[::-1]  # column j - 1 stands at columns - j
    older, old = np.zeros((rows + 1, len(n)), np.int16), np.zeros((rows + 1, len(n)), np.int16)
    steps = np.full((rows + columns + 1, rows + 1, len(n)), INSERT, np.uint8)
    for d in range(1, rows + columns + 1):
        if d <= rows:
            steps[d, d] = DELETE
        lo, hi = max(1, d - columns), min(rows, d - 1)
        new = np.zeros_like(old)
        if lo <= hi:
            like = a[lo - 1 : hi] == back[columns - d + lo : columns - d + hi + 1]
            best = older[lo - 1 : hi] + np.where(like, same, unlike)
            np.maximum(best, old[lo - 1 : hi], out=best)
            np.maximum(best, old[lo : hi + 1], out=best)
            kind = steps[d, lo : hi + 1]
            np.copyto(kind, PAIR, where=best != old[lo : hi + 1])
            np.copyto(kind, DELETE, where=best == old[lo - 1 : hi])
            new[lo : hi + 1] = best
        older, old = old, new
    who, kind, i, j = _walked(steps, every, n, m, diagonal=True)
    return who, np.arange(len(who)) - np.searchsorted(who, who), kind, i, j


def _listed_pairs(pairs: list[tuple[list[str], list[str]]]) -> Coded:
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(t, len(number)) for pair in pairs for side in pair for t in side], np.int64)
    n, m = (np.array([len(pair[k]) for pair in pairs], np.int64) for k in (0, 1))
    return Coded(pa.array(range(len(pairs))), ids, list(number), n, m)


def _operations(part: Coded, who, place, step, i, j, limited, schema: StructType) -> pa.RecordBatch:
    """Steps of episodes as rows of ``schema``."""
    kind, score = _kinds(part, who, step, i, j), np.zeros(len(who))
    score[kind == 3] = 1.0
    s, t = part.at[who] + i, part.at[who] + part.n[who] + j
    other = np.flatnonzero(kind == 2)
    x, y = part.ids[s[other]], part.ids[t[other]]
    some = (part.letters[x] > 1) | (part.letters[y] > 1)
    other, x, y = other[some], x[some], y[some]
    if len(other):
        pairs, at = np.unique(x * len(part.names) + y, return_inverse=True)
        score[other] = np.array([ratio(part.names[k // len(part.names)], part.names[k % len(part.names)]) for k in pairs.tolist()])[at]
    fields = to_arrow_schema(schema)
    columns = [
        part.ep.take(pa.array(who)), pa.array(place), pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int8)), pa.array(["delete", "insert", "replace", "match"])),
        pa.array(i, mask=step == INSERT), pa.array(j, mask=step == DELETE), pa.array(score), pa.array(limited),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)


def _kinds(part: Coded, who, step, i, j) -> np.ndarray:
    """By step 0 delete, 1 insert, 2 replace, 3 match."""
    kind = np.where(step == DELETE, 0, np.where(step == INSERT, 1, 2))
    pairs = np.flatnonzero(step == PAIR)
    w = who[pairs]
    x, y = part.ids[part.at[w] + i[pairs]], part.ids[part.at[w] + part.n[w] + j[pairs]]
    kind[pairs[(x == y) & (part.letters[x] > 0)]] = 3
    return kind


def _runs(part: Coded, who, place, step, i, j, limited, schema: StructType) -> pa.RecordBatch:
    """The maximal runs of what is no match, by episode and in order."""
    other, fresh, ends = _kinds(part, who, step, i, j) != 3, np.ones(len(who), bool), np.ones(len(who), bool)
    fresh[1:] = ends[:-1] = who[1:] != who[:-1]
    first, last = other & fresh, other & ends
    first[1:] |= other[1:] & ~other[:-1]
    last[:-1] |= other[:-1] & ~other[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    w = who[first]
    size = last - first + 1
    # a step stands at the next place of either side, so a run holds what lies between its first step and the one after its last
    end = {"left": i[last] + (step[last] != INSERT), "right": j[last] + (step[last] != DELETE)}
    begin = {"left": i[first], "right": j[first]}
    none = {c: end[c] == begin[c] for c in end}
    ahead, behind = fresh[first], ends[last]
    nth = np.arange(len(w)) - np.searchsorted(w, w) + 1
    columns = {
        "ep": part.ep.take(pa.array(w)), "first_op": pa.array(place[first]), "n_ops": pa.array(size),
        **{f"{c}_{x}": pa.array(v, mask=none[c]) for c in end for x, v in (("from", begin[c]), ("to", end[c] - 1))},
        "case_id": pc.binary_join_element_wise("case-", pa.array(nth).cast(pa.string()), ""),
        **{f"before_{c}": pa.array(begin[c] - 1, mask=ahead) for c in end}, **{f"after_{c}": pa.array(end[c], mask=behind) for c in end},
    }
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in fields], schema=fields)


def _run_schema(left: DataFrame) -> StructType:
    longs = ["first_op", "n_ops", "left_from", "left_to", "right_from", "right_to"]
    around = ["before_left", "before_right", "after_left", "after_right"]
    return StructType([StructField("ep", left.schema["ep"].dataType), *(StructField(c, LongType()) for c in longs), StructField("case_id", StringType()), *(StructField(c, LongType()) for c in around)])


def _script_schema(left: DataFrame) -> StructType:
    more = [("op_pos", LongType()), ("kind", StringType()), ("left_idx", LongType()), ("right_idx", LongType()), ("score", DoubleType()), ("limited", BooleanType())]
    return StructType([StructField("ep", left.schema["ep"].dataType), *(StructField(n, t) for n, t in more)])


def fit_times(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(rate, offset) of anchors in order; None where not even the median anchor fits.

    The rate is 1 unless the median slope of up to 128 evenly spaced anchors, from 0.5 to 2, leaves a
    smaller median residual.
    """
    if not len(x):
        return None
    rate, offset = 1.0, float(np.median(y - x))
    miss = float(np.median(np.abs(x + offset - y)))
    spread = x[-1] - x[0]
    if len(x) > 1 and spread >= 5.0:
        pick = np.arange(len(x)) if len(x) <= 128 else np.array([round(k * (len(x) - 1) / 127) for k in range(128)])
        i, j = np.triu_indices(len(pick), 1)
        dx, dy = x[pick][j] - x[pick][i], y[pick][j] - y[pick][i]
        far = dx >= max(1.0, spread * 0.1)
        if far.any():
            r = float(np.median(dy[far] / dx[far]))
            if 0.5 <= r <= 2.0:
                o = float(np.median(y - r * x))
                left = float(np.median(np.abs(r * x + o - y)))
                if left < miss:
                    rate, offset, miss = r, o, left
    return None if miss > max(2.0, abs(y[-1] - y[0]) * 0.05) else (rate, offset)


def align_timed(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """J1 with W24's priors: as ``align_tokens`` over (ep, idx, token, cue_id, start, end) and (ep, idx, token, start, end).

    Times are seconds, a token's being its cue's. Where a token that both sides have stands twice on
    one and all times are in order, a second pass prefers pairs near the expected time; unique matches
    of the first pass tell how the cues' times became the words'.
    """

    schema = _script_schema(tokens)

    def run(batches):
        for part, found, _ in _timed(batches):
            for these, steps in _in_turn(part, found):
                yield _operations(these, *steps, schema)

    return _timed_sides(tokens, words).mapInArrow(run, schema)


def timed_matches(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(ep, cue_id, right_idx): the matches of ``align_timed`` by the cue of their token; tokens may come in pieces, each of one cue."""
    schema = StructType([StructField("ep", tokens.schema["ep"].dataType), StructField("cue_id", LongType()), StructField("right_idx", LongType())])

    def run(batches):
        for part, found, cue in _timed(batches):
            who = np.repeat(np.arange(len(found)), [len(kind) for kind, *_ in found])
            step, i, j = (np.concatenate([f[c] for f in found]) for c in range(3))
            hit = np.flatnonzero(_kinds(part, who, step, i, j) == 3)
            who, i, j = who[hit], i[hit], j[hit]
            yield pa.RecordBatch.from_arrays([part.ep.take(pa.array(who)), cue.take(pa.array((np.cumsum(part.n) - part.n)[who] + i)), pa.array(j)], schema=to_arrow_schema(schema))

    return _timed_sides(tokens, words).mapInArrow(run, schema)


TIMES = ["idx", "tokens", "cue_id", "start", "end"]


def _timed_sides(tokens: DataFrame, words: DataFrame) -> DataFrame:
    pieces = lambda d: d if "tokens" in d.columns else d.withColumn("tokens", F.array("token"))
    return _sides(*(pieces(d).select("ep", *TIMES) for d in (tokens, words.withColumn("cue_id", F.lit(None).cast("long")))), TIMES)


def _timed(batches) -> Iterator[tuple[Coded, list, pa.Array]]:
    """(episodes, their scripts as ``scripts`` has them, cues of their left tokens), some at once."""
    some, held = [], 0
    for batch in _whole(batches):
        tokens = batch.column("tokens")
        size = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
        names, row = tokens.flatten().fill_null("").to_numpy(zero_copy_only=False).tolist(), np.repeat(np.arange(batch.num_rows), size)
        side = np.repeat(batch.column("side").to_numpy(), size)
        start, end = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[row] for c in ("start", "end"))
        cue, ep, ends = batch.column("cue_id").take(pa.array(row)), batch.column("ep"), np.array([*_changes(batch, ("ep",)), batch.num_rows])
        at = 0
        for first, last in zip([0, *np.cumsum(size)[ends - 1].tolist()], np.cumsum(size)[ends - 1].tolist()):
            mid = first + int(np.count_nonzero(side[first:last] == 0))
            a, b = ({"token": names[x:y], "start": start[x:y], "end": end[x:y], "cue_id": cue[x:y]} for x, y in ((first, mid), (mid, last)))
            if some and (len(some) == MANY or held + last - first > TOKENS):
                yield _timed_scripts(some)
                some, held = [], 0
            some.append((ep[int(ends[at]) - 1].as_py(), a, b))
            held, at = held + last - first, at + 1
    if some:
        yield _timed_scripts(some)


def _timed_scripts(some: list[tuple[object, dict, dict]]) -> tuple[Coded, list, pa.Array]:
    sides = [Sides(a["token"], b["token"]) for _, a, b in some]
    found, again = scripts(sides), []
    for k, (s, (kind, i, j, _), (_, a, b)) in enumerate(zip(sides, found, some)):
        paired_ = kind == PAIR
        s.priors = time_priors_of(a, b, s.left, s.right, zip(i[paired_].tolist(), j[paired_].tolist()))
        if s.priors is not None:
            again.append(k)
    for k, (*steps, more) in zip(again, scripts([sides[k] for k in again])):
        found[k] = (*steps, found[k][3] or more)
    part = _listed_pairs([(s.left, s.right) for s in sides])
    part.ep = pa.array([ep for ep, *_ in some])
    return part, found, pa.concat_arrays([a["cue_id"] for _, a, _ in some])


def time_priors_of(a: dict, b: dict, left: list[str], right: list[str], pairs: Iterable[tuple[int, int]]) -> tuple | None:
    """(expected times, radii, word centres) of a second pass; None where it would not help or times are unusable.

    Sides are arrays by column, ``pairs`` the places that the first pass paired.
    """
    n, m = Counter(left), Counter(right)
    if not any(t and (n[t] > 1 or m[t] > 1) for t in n.keys() & m.keys()):
        return None
    (start, end), (w_start, w_end) = ((np.array(x["start"], float), np.array(x["end"], float)) for x in (a, b))
    _, first, cue, size = np.unique(a["cue_id"].fill_null(-1).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True, return_counts=True)
    heads = np.sort(first)
    for s, e in ((start[heads], end[heads]), (w_start, w_end)):
        if not len(s) or not np.isfinite(s).all() or not np.isfinite(e).all() or (s < 0).any() or (e < s).any() or (np.diff(s) < 0).any():
            return None
    order, nth = np.argsort(cue, kind="stable"), np.empty(len(cue), np.int64)
    nth[order] = np.arange(len(cue)) - (np.cumsum(size) - size)[cue[order]]
    lasts = end - start
    expected, radius = start + lasts * ((nth + 0.5) / size[cue]), np.maximum(LEAST_RADIUS, lasts)
    times = (w_start + w_end) / 2
    anchors = [(i, j) for i, j in pairs if left[i] and left[i] == right[j] and n[left[i]] == 1 and m[right[j]] == 1]
    if anchors:
        x, y = expected[[i for i, _ in anchors]], times[[j for _, j in anchors]]
        fit = None if (np.diff(x) <= 0).any() or (np.diff(y) < 0).any() else fit_times(x, y)
        if fit is not None:
            expected, radius = fit[1] + fit[0] * expected, np.maximum(LEAST_RADIUS, fit[0] * radius)
    return expected, radius, times


def band_limited_flags(ops: DataFrame) -> DataFrame:
    """One warning an episode whose bands fell short of the unique exact pairs."""
    return ops.where("limited").select("ep").distinct().select("ep", F.lit("alignment_band_limited").alias("kind"), F.lit("warning").alias("severity"))


def divergences(ops: DataFrame) -> DataFrame:
    """A5: maximal runs of operations that are no match, with the matches on either side."""
    w = Window.partitionBy("ep").orderBy("op_pos")
    matched = F.col("kind") == "match"
    d = ops.withColumn("after", F.sum(matched.cast("int")).over(w)).where(~matched)
    spans = d.groupBy("ep", "after").agg(F.min("op_pos").alias("first_op"), F.count("*").alias("n_ops"), F.min("left_idx").alias("left_from"), F.max("left_idx").alias("left_to"), F.min("right_idx").alias("right_from"), F.max("right_idx").alias("right_to"))
    return spans.withColumn("case_id", F.concat(F.lit("case-"), F.row_number().over(Window.partitionBy("ep").orderBy("first_op")))).drop("after")


def _described(ops: DataFrame, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Operations with their token (ep, idx, token, cue_id) as ``l`` and word (ep, word_idx, text, start_us, end_us, confidence, speaker) as ``r``."""
    first = F.min("idx").over(Window.partitionBy("ep", "cue_id"))
    left = tokens.select("ep", F.col("idx").alias("left_idx"), F.struct("token", "cue_id", (F.col("idx") - first).alias("nth")).alias("l"))
    right = words.select("ep", F.col("word_idx").alias("right_idx"), F.struct("text", "start_us", "end_us", "confidence", "speaker").alias("r"))
    return ops.join(dealt(left), ["ep", "left_idx"], "left").join(dealt(right), ["ep", "right_idx"], "left")


def _texts(item: Column, text: str) -> Column:
    """Texts in the order of operations, joined by blanks; those without are left out."""
    listed = F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("op_pos", item[text].alias("text")))))
    return F.array_join(F.transform(listed, lambda x: x["text"]), " ")


def divergence_details(ops: DataFrame, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """A5: maximal runs of operations that are no match, with all that a decision needs of them.

    ep, nth, case_id, cue_ids, srt_text, asr_text, token_idx, word_idx, confidence (the least of its words, 0
    without any), speaker_ids, start_us and end_us (of its words, else of the matches around) and, of
    runs that only insert: the cues, times and speakers of the matches around, and how many tokens of
    their common cue stand before.
    """
    w = Window.partitionBy("ep").orderBy("op_pos")
    matched = F.col("kind") == "match"
    hit = F.when(matched, F.struct("l", "r"))
    d = _described(ops, tokens, words).withColumn("run", F.sum(matched.cast("int")).over(w))
    d = d.withColumn("p", F.last(hit, ignorenulls=True).over(w)).withColumn("n", F.first(hit, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).where(~matched)
    some = lambda c: F.array_sort(F.collect_set(c))
    g = d.groupBy("ep", "run").agg(
        F.min("op_pos").alias("first_op"), some("l.cue_id").alias("cue_ids"), _texts(F.col("l"), "token").alias("srt_text"), _texts(F.col("r"), "text").alias("asr_text"),
        some("left_idx").alias("token_idx"), some("right_idx").alias("word_idx"), F.coalesce(F.min("r.confidence"), F.lit(0.0)).alias("confidence"), some("r.speaker").alias("speaker_ids"),
        F.min("r.start_us").alias("a"), F.max("r.end_us").alias("z"), F.first("p").alias("p"), F.first("n").alias("n"),
    )
    inserted = (F.size("word_idx") > 0) & (F.size("token_idx") == 0)
    only = lambda c, name: F.when(inserted, F.col(c)).alias(name)
    nth = F.row_number().over(Window.partitionBy("ep").orderBy("first_op")).cast("long")
    inside = inserted & (F.col("p.l.cue_id") == F.col("n.l.cue_id"))
    return g.withColumn("nth", nth).select(
        "ep", "nth", F.concat(F.lit("case-"), "nth").alias("case_id"), "cue_ids", "srt_text", "asr_text", "token_idx", "word_idx", "confidence", "speaker_ids",
        F.coalesce("a", "p.r.end_us", "n.r.start_us").alias("start_us"), F.coalesce("z", "n.r.start_us", "p.r.end_us").alias("end_us"),
        only("p.l.cue_id", "left_cue"), only("n.l.cue_id", "right_cue"), F.when(inside, F.col("n.l.nth")).alias("insert_at"),
        only("p.r.end_us", "left_end_us"), only("n.r.start_us", "right_start_us"), only("p.r.speaker", "left_speaker"), only("n.r.speaker", "right_speaker"),
    )


def anchor_regions(ops: DataFrame, tokens: DataFrame, words: DataFrame, least: int = 3) -> DataFrame:
    """A4: runs of ``least`` matches or more: ep, nth, cue_ids, srt_text, asr_text, start_us, end_us, n, score (their mean)."""
    w = Window.partitionBy("ep").orderBy("op_pos")
    matched = F.col("kind") == "match"
    d = _described(ops, tokens, words).withColumn("run", F.sum((~matched).cast("int")).over(w)).where(matched)
    g = d.groupBy("ep", "run").agg(
        F.min("op_pos").alias("first_op"), F.array_sort(F.collect_set("l.cue_id")).alias("cue_ids"), _texts(F.col("l"), "token").alias("srt_text"), _texts(F.col("r"), "text").alias("asr_text"),
        F.min("r.start_us").alias("start_us"), F.max("r.end_us").alias("end_us"), F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"),
    ).where(F.col("n") >= least)
    return g.withColumn("nth", F.row_number().over(Window.partitionBy("ep").orderBy("first_op")).cast("long")).drop("run", "first_op")


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """J2 in the engine: tokens once on both sides; an episode whose order disagrees gives none."""
    one = lambda d, n: d.groupBy("ep", "token").agg(F.count("*").alias("n"), F.min("idx").alias(n)).where("n = 1 and token <> ''").drop("n")
    pairs = one(left, "left_idx").join(one(right, "right_idx"), ["ep", "token"])
    w = Window.partitionBy("ep").orderBy("left_idx")
    falls = F.coalesce(F.col("right_idx") < F.lag("right_idx").over(w), F.lit(False))
    bad = F.max(falls).over(Window.partitionBy("ep"))
    return pairs.withColumn("falls", falls).withColumn("bad", F.max("falls").over(Window.partitionBy("ep"))).where(~F.col("bad")).select("ep", "token", "left_idx", "right_idx")


def sampled(anchors: DataFrame, most: int = 128) -> DataFrame:
    """All anchors of an episode or ``most`` of them, evenly spaced from the first to the last, with their number."""
    n, i = F.count("*").over(Window.partitionBy("ep")), F.row_number().over(Window.partitionBy("ep").orderBy("x", "y")) - 1
    d = anchors.withColumn("n", n).withColumn("i", i)
    # halves go to the even neighbour
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("n") - 1) / float(most - 1)))
    return d.where((F.col("n") <= most) | F.array_contains(picked, F.col("i").cast("double"))).select("ep", "x", "y", "i")


def theil_sen(anchors: DataFrame) -> DataFrame:
    """Rate and offset of each episode's anchors (ep, x, y in seconds) as ``fit_times`` has them; what it refuses has no row."""

    def fits(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        found = [fit_times(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys)]
        return pd.DataFrame([(None, None) if f is None else f for f in found], columns=["rate", "offset"], dtype=float)

    each = anchors.where("x is not null and y is not null").groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("a"), F.count("*").alias("n"))
    fit = F.pandas_udf(fits, "rate double, offset double")(F.col("a.x"), F.col("a.y"))
    return each.select("ep", fit.alias("fit"), "n").select("ep", "fit.rate", "fit.offset", "n").where("rate is not null")


def outliers(anchors: DataFrame, fits: DataFrame, limit: Column) -> DataFrame:
    """Anchors whose residual to the fit passes the limit."""
    resid = F.abs(F.col("y") - (F.col("rate") * F.col("x") + F.col("offset")))
    return anchors.join(fits.drop("n"), "ep").withColumn("residual", resid).where(F.col("residual") > limit)


def worst_by_cue(found: DataFrame, order: str) -> DataFrame:
    """Of each cue (ep, cue_id) the outlier with the largest residual, the first by ``order`` among equals."""
    rank = F.row_number().over(Window.partitionBy("ep", "cue_id").orderBy(F.desc("residual"), order))
    return found.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
