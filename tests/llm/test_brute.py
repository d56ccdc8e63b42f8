"""Operators without SQL against plain reimplementations."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cuelake.llm import langid, toxicity
from cuelake.llm.common import table
from cuelake.llm.embedding_dedup import embedding_components
from cuelake.llm.queries import vocabulary
from cuelake.llm.substring_dedup import SubstringDedup, substring_dedup
from cuelake.llm.wordscan import mix, scan

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lowered(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def naive_chunks(text: str | None, p: SubstringDedup):
    """(words, start of each, [(first, stop)]) of a text."""
    raw = (text or "").encode()
    found = list(WORD.finditer(raw))
    words = [lowered(m.group()) for m in found]
    gear = [int(mix(scan([w.decode()])[0] ^ np.uint64(0x5851F42D4C957F2D))[0]) & 0xFFFF for w in words]
    chunks, first = [], 0
    for i in range(len(words)):
        rolled = sum(gear[i - back] << 4 * back for back in range(4) if i >= back) & 0xFFFF
        if i + 1 == len(words) or (i >= 4 and rolled < 65536 // p.mean_words):
            chunks.append((first, i + 1))
            first = i + 1
    return words, [m.start() for m in found], chunks


def naive_shortened(docs: dict[int, str | None], p: SubstringDedup = SubstringDedup()) -> dict[int, str | None]:
    parts = {d: naive_chunks(t, p) for d, t in docs.items()}
    holders = defaultdict(set)
    for d, (words, _, chunks) in parts.items():
        for a, b in chunks:
            holders[tuple(words[a:b])].add(d)
    out = {}
    for d, text in docs.items():
        words, starts, chunks = parts[d]
        raw, cut, run = (text or "").encode(), [], []
        for a, b in [*chunks, (len(words), len(words) + 1)]:
            if b <= len(words) and min(holders[tuple(words[a:b])]) < d:
                run += [(a, b)]
                continue
            if run and run[-1][1] - run[0][0] >= p.min_words:
                cut.append((starts[run[0][0]], starts[run[-1][1]] if run[-1][1] < len(words) else len(raw)))
            run = []
        for a, b in reversed(cut):
            raw = raw[:a] + raw[b:]
        out[d] = text if text is None else raw.decode()
    return out


def test_gear_chunks(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    long = " ".join(f"word{i * i % 977}" for i in range(400))
    docs |= {10_001: long, 10_002: f"Before it. {long} After it.", 10_003: " ".join(long.split()[50:101]), 10_004: None, 10_005: "", 10_006: "ÄÖ Ü " * 30}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup(frame).collect()}
    assert got == naive_shortened(docs) and got[10_002] != docs[10_002]


def test_language_popcounts(spark, sf):
    docs = table(spark, sf, "documents")
    p = langid.LangId(rows_per_lang=200, grams_per_lang=2000, bits=14)
    m = langid.fit(docs, p)
    rows = {r.doc_id: r for r in langid.language(docs, m, p).collect()}
    rate = [sum(int(w[k // 64]) >> k % 64 & 1 for w in m.masks) / len(m.masks) for k in range(len(m.langs))]
    assert np.allclose(m.false_rate, [r**p.hashes for r in rate])
    for doc in docs.where("text is not null").limit(40).collect():
        hashes = langid._grams([doc.text], p.n)[0]
        held = Counter()
        for h in hashes.tolist():
            slots = [int(s[0]) for s in langid._slots(np.array([h], np.uint64), p.bits, p.hashes)]
            held.update(k for k in range(len(m.langs)) if all(int(m.masks[s][k // 64]) >> k % 64 & 1 for s in slots))
        real = [max(held[k] - len(hashes) * m.false_rate[k], 0) / (1 - m.false_rate[k]) for k in range(len(m.langs))]
        if any(c.isalpha() for c in doc.text):
            best = max(range(len(real)), key=lambda k: (real[k], -k))
            others = sorted(real)[-2]
            assert rows[doc.doc_id].lang_pred == m.langs[best]
            assert rows[doc.doc_id].score == pytest.approx(real[best] / (real[best] + others) if real[best] else 0.0)
        else:
            assert rows[doc.doc_id].lang_pred == "und"


def test_grams_of_other_languages_pass_at_the_false_rate():
    """The correction of the popcounts: what no language holds is found as often as said."""
    rng = np.random.default_rng(3)
    p = langid.LangId(bits=12)
    masks = np.zeros((1 << p.bits, 1), np.uint64)
    masks[rng.choice(1 << p.bits, 1200, replace=False), 0] = 1
    m = langid.LangModel(["x"], masks, np.array([(1200 / 4096) ** p.hashes]))
    h = mix(rng.integers(0, 2**63, 200_000).astype(np.uint64))
    has = np.ones(len(h), bool)
    for slot in langid._slots(h, p.bits, p.hashes):
        has &= m.masks[slot, 0] == 1
    assert has.mean() == pytest.approx(m.false_rate[0], rel=0.03)


def test_planted_pairs_at_the_limit_are_all_linked(spark):
    """1,500 pairs of one label with cosines from 0.980 to 0.983 among 64 dimensions: every link, no other."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.983, (1500, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.stack([a, b], 1).reshape(-1, 64))]
    got = {r.vec_id: r for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 1 and got[i].component_id == i // 2 * 2 for i in range(3000))


def naive_near(docs: dict[int, str | None]) -> set[int]:
    """Documents that stay: the smallest of each group of likeness 0.8 on five words."""
    sets = {}
    for d, t in docs.items():
        w = [lowered(m.group()) for m in WORD.finditer((t or "").encode())]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in docs if find(d) == d}


def naive_copies(rows: dict[int, tuple[str | None, str | None]]) -> dict[int, int]:
    """How often each document (text, source) is taken: targets by filling up, then whole copies and one draw."""
    size = {d: len(WORD.findall((t or "").encode())) for d, (t, _) in rows.items()}
    sources = sorted({s for _, s in rows.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in rows if rows[d][1] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    full, left = set(), 1.5 * sum(total.values())
    while True:  # those that would pass their limit stop there
        free = [s for s in sources if s not in full]
        over = {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2.0 * total[s]}
        if not over:
            break
        full |= over
        left -= sum(2.0 * total[s] for s in over)
    target = {s: 2.0 * total[s] if s in full else weight[s] * left / sum(weight[x] for x in free) for s in sources}
    out = {}
    for d, (_, s) in rows.items():
        rate = target[s] / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) / 16**13
        out[d] = int(rate) + (draw < rate - int(rate))
    return out


def test_the_whole_pipeline(spark, sf):
    """Every stage but the scores of the first by plain loops; the last by the library's tokens."""
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    clean = {r.doc_id for r in toxicity.toxicity(docs, model).collect() if r.score < 0.5}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect() if r.doc_id in clean}
    stay = naive_near({d: t for d, (t, _) in rows.items()})
    short = naive_shortened({d: rows[d][0] for d in stay})
    copies = naive_copies({d: (short[d], rows[d][1]) for d in stay})
    library = Tokenizer.from_file(vocabulary())
    n = {d: len(library.encode(short[d] or "", add_special_tokens=False).ids) + 1 for d in stay if copies[d]}
    pieces = corpus_pipeline.run(spark, sf).collect()
    got = Counter()
    for r in pieces:
        assert r.doc_tokens == n[r.doc_id]
        got[r.doc_id] += r.length
    assert got == Counter({d: n[d] * copies[d] for d in n})
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(clean) > len(stay) > len(n) > 50
