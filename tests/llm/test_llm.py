"""Each operator against brute force on small inputs, and on nulls, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import embedding_dedup, extraction, langid, licenses, mixing, near_dedup, packing, quality, substring_dedup, toxicity
from cuelake.llm.queries import vocabulary
from cuelake.llm.wordscan import scan, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, score double, token long, host string, comp long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, long and repeated texts, clashing column names."""
    long = words(60_000, 1)
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, " \t\n", "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (5, long, None, None), (None, "some words here", "en", "a"), (6, "x", "fr", "c"), (7, "one two", "fr", "c"), (8, "ONE  two", "fr", "c"), (9, "é ñ 字 😀", "es", "c")]
    return spark.createDataFrame([(*r, None, 0, 0.5, 1, "h", 9) for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def near_brute(rows, k, num, den):
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in rows], k)]
    ids = [d for d, _ in rows]
    parent = {d: d for d in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = top(ids[i]), top(ids[j])
                parent[max(a, b)] = min(a, b)
    return {d: top(d) for d in ids}


def test_scan_finds_words_and_folds_only_ascii():
    h, b = scan(["A b\x0bÉ", None, "a\x1fb", "é"])
    assert b.tolist() == [0, 3, 3, 4, 5]
    assert h[0] != h[3] and h[2] != h[4]
    assert len(set(scan(["a" * n for n in range(1, 40)])[0].tolist())) == 39


def test_near_dedup_equals_brute_force(spark):
    r = random.Random(3)
    rows, base = [], words(120, 5).split()
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = "new%d" % r.randrange(10**6)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, words(40, 50 + i)) for i in range(20)] + [(200, rows[0][1]), (201, "a b"), (202, "A b"), (203, "")]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for p in (near_dedup.NearDedup(3, 85, 100), near_dedup.NearDedup()):
        got = {x.doc_id: x.component_id for x in near_dedup.near_components(df, p).collect()}
        assert got == near_brute(rows, p.words, p.num, p.den)


def test_near_dedup_edges(odd, none):
    got = near_dedup.near_components(odd, near_dedup.NearDedup(3, 85, 100)).collect()
    assert len(got) == 11
    by = {x.doc_id: x for x in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[5].component_id == 4 and not by[5].kept and by[8].component_id == 7
    assert near_dedup.near_components(none).count() == 0
    left = near_dedup.drop_near(odd, near_dedup.NearDedup(3, 85, 100))
    assert left.columns == odd.columns and 5 not in {x.doc_id for x in left.collect()}


def test_odd_sketch_passes_pairs_at_the_limit():
    p = near_dedup.NearDedup(3, 85, 100)
    assert p.bands * p.rows <= p.samples and 0 < p.most_odd < p.bits / 4


def test_language(spark, odd, none):
    en, fr = "the house and the garden were there with thing ", "le jardin et la maison sont dans cette région où "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {x.doc_id: x for x in langid.language(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    edge = [x.lang_pred for x in langid.language(odd, model).collect()]
    assert edge.count("und") == 3 and len(edge) == 11
    assert langid.fit(none) is None and langid.language(none, None).count() == 0
    assert {x.lang_pred for x in langid.language(odd, None).collect()} == {"und"}
    assert model.masks.dtype == np.uint64 and (model.false_rate < 0.1).all()


def test_language_of_a_long_text_counts_all_of_it(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("abab " * 50, "aa"), ("cdcd " * 50, "cc")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    long = spark.createDataFrame([(1, "abab " * 300_000 + "cdcd " * 500_000)], "doc_id long, text string")
    assert langid.language(long, model).first().lang_pred == "cc"


def test_extraction_of_an_article():
    page = """<html><head><title>t</title></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
    <main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <i>two</i>
    three&nbsp;four.<p>Five<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input name=q> Search</form><section class="comments"><p>nice</p></section></article></main>
    <aside><p>side</p></aside><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""
    assert extraction.main_text(page)[0] == "Title & more\n\nOne two three four.\n\nFive\n\na\n\nb"
    assert extraction.main_text("")[0] == "" and extraction.main_text("a <b")[0] == "a"
    assert extraction.main_text("<p>" * 3000 + "x")[0] == "x"


def test_extraction_learns_a_hosts_template(spark):
    r = random.Random(1)
    pages = []
    for i in range(30):
        body = f"<div><div>Menu of the site</div><div><p>{words(30, i)}</p><p>{words(20, 99 + i)}</p></div><div>All about us {'' if i % 2 else ''}</div></div>"
        pages.append((i, "http://host.example/%d" % i, body))
    pages += [(100, None, None), (101, "http://x.example", ""), (101, "http://x.example", "")]
    r.shuffle(pages)
    got = extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 33
    for x in got:
        if x.page_id < 100:
            assert x.text == words(30, x.page_id) + "\n\n" + words(20, 99 + x.page_id) and x.n_template >= 2
        else:
            assert x.text == ""
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def license_brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, odd, none):
    texts = ["CC BY cc-by 4", "the GNU General Public License. general public", "All rights\nreserved; all rights reserved", "cc", "by cc", "cc by by cc by", None, "", "Released under the MIT License.", "x " * 5000 + "cc by", "Licensed under the apache new license version 2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.license_report(df).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == license_brute(t)
    assert got[8].labels == "mit" and got[8].score == 1.0
    assert got[10].labels == "apache-2.0"  # one word more: two neighbouring diagonals
    assert licenses.license_report(none).count() == 0 and licenses.license_report(odd).count() == 11


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            c = r.standard_normal(16)
            rows += [(c + r.standard_normal(16) * s, label) for s in (0, 0.02, 0.05, 0.1)]
    rows += [(rows[0][0], 0), (rows[0][0] * 3, 0), (rows[0][0], None), (np.zeros(16), 0), (np.full(16, np.nan), 0), (np.ones(3), 0)]
    data = [(i, [float(np.float32(v)) for v in x], y) for i, (x, y) in enumerate(rows)] + [(900, None, 0), (901, [1.0, None], 0), (902, [float("inf")], 1), (903, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    p = embedding_dedup.EmbeddingDedup(block=16)
    got = {x.vec_id: x for x in embedding_dedup.embedding_components(df, p).collect()}
    fine = {i: np.array(x, float) for i, x, y in data if y is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    lab = {i: y for i, _, y in data}
    links, parent = Counter(), {i: i for i, _, _ in data}
    for i in fine:
        for j in fine:
            if i < j and lab[i] == lab[j] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)

    def top(x):
        return x if parent[x] == x else top(parent[x])

    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (links[i], top(i), top(i) == i) for i, _, _ in data}
    assert embedding_dedup.embedding_components(df.where("false")).count() == 0


def test_substring_passage_goes_from_later_documents(spark, odd, none):
    passage = words(60, 77)
    rows = [(i, f"{words(30, 200 + i)} {passage} {words(30, 300 + i)}") for i in range(12)] + [(50, words(80, 9)), (51, words(80, 10))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in substring_dedup.substring_dedup(df).collect()}
    assert got[0].text == rows[0][1] and got[50].n_gone == got[51].n_gone == 0
    for i in range(1, 12):
        assert passage not in got[i].text and 30 < got[i].n_gone <= 60
        raw = rows[i][1].encode()
        rest = b"".join(raw[a:b] for a, b in zip([0, *(g.stop for g in got[i].gone)], [*(g.start for g in got[i].gone), len(raw)]))
        assert rest.decode() == got[i].text
    out = substring_dedup.substring_dedup(odd)
    assert out.count() == 11 and out.columns[: len(odd.columns)] == odd.columns
    by = {x.doc_id: x for x in out.collect()}
    assert by[2].text is None and by[4].n_gone == 0 and by[5].text == ""
    assert substring_dedup.substring_dedup(none).count() == 0


def quality_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(hit)


def test_quality_counts(spark, odd, none):
    texts = [None, "", " \n ", "a b c a b c", "a a a a a", "a b c d a b c", "x\nx\n x\nx\n\n\n", "#*$%&|<> é😀", "a b", "a\x1fb c a\x1fb c\x85d", words(300, 4), "w " * 400, "\n".join([words(9, i % 5) for i in range(40)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality(df).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == quality_brute(t), i
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)
    assert quality.quality(odd).count() == 11 and quality.quality(none).count() == 0


def test_quality_em_tells_junk():
    good, junk = sum(2 * 3**k for k in range(10)), sum((1 if k in (1, 2, 3) else 2) * 3**k for k in range(10))
    q = quality.posteriors({good: 900, junk: 100}, 10, quality.Quality())
    assert q[good] > 0.9 and q[junk] < 0.1 and quality.posteriors({}, 10, quality.Quality()) == {}


def test_mixing_targets(spark, odd, none):
    rows = [("a", 100), ("b", 1000), ("c", 50), (None, 10), ("d", 0)]
    got = {x.source: x for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # by hand: 1.5 * 1160 words by weights 3, 1, 2, 3, 1; a, c and null stop at twice their size, d has none
    assert got["a"].target == 200 and got["c"].target == 100 and got[None].target == 20 and got["d"].target == 0
    assert got["b"].target == pytest.approx(1.5 * 1160 - 320)
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == 11 and all(0 <= x.copies <= 2 for x in plan) and mixing.mix_plan(none).count() == 0
    again = {(x.doc_id, x.copies) for x in mixing.mix_plan(odd).collect()}
    assert again == {(x.doc_id, x.copies) for x in plan}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(x.copies for x in plan)


def test_segments_are_maximal():
    def slow(scores):  # all maximal segments by their definition: repeatedly the best, then both sides
        if not scores or max(scores) <= 0:
            return []
        best = max(((sum(scores[i:j]), i - j, -i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        _, i, j = best
        return slow(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in slow(scores[j:])]

    r = random.Random(8)
    for _ in range(200):
        s = [r.choice([-1.0, -1.0, 1.5, 2.25, 4.0]) for _ in range(r.randint(0, 12))]
        at = np.array([i for i, x in enumerate(s) if x > 0], int)
        gain = np.array([s[i] for i in at])
        got = toxicity.segments(at, gain, 1.0)
        assert sum(x for *_, x in got) == pytest.approx(sum(sum(s[a : b + 1]) for a, b in slow(s)))


def test_segments_equal_their_definition():
    """Scores without ties: each maximal segment by itself, its ends and its score."""

    def slow(scores, at=0):
        best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        total, i, j = best
        return [*slow(scores[:i], at), (at + i, at + j - 1, total), *slow(scores[j:], at + j)]

    r = random.Random(9)
    for _ in range(200):
        s = [r.uniform(0.5, 3) if r.random() < 0.4 else -0.7 for _ in range(r.randint(0, 14))]
        at = np.array([i for i, x in enumerate(s) if x > 0], int)
        got = toxicity.segments(at, np.array([s[i] for i in at]), 0.7)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(s)]
        assert [x for *_, x in got] == pytest.approx([x for *_, x in slow(s)])


def test_lambda_solves_its_equation():
    share, odds = np.array([0.01, 0.002]), np.array([1.5, 3.0])
    rate = toxicity._rate(share, odds, 0.05)
    assert (share * np.exp(rate * odds)).sum() + (1 - share.sum()) * np.exp(-rate * 0.05) == pytest.approx(1)


def test_held_out_toxic_documents_are_caught(spark):
    """At least nine of ten of the fold that nothing is learned from, few others."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    held = [(x.score >= 0.5, x.toxic) for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    caught, toxic = sum(p and y for p, y in held), sum(y for _, y in held)
    assert caught >= 0.9 * toxic and sum(p and not y for p, y in held) <= 0.01 * len(held)


def test_toxicity_learns_and_scores(spark, odd, none):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        t = words(60, 1000 + i).split()
        if i % 5 == 0:
            for w in ("vile", "awful", "scum!"):
                t.insert(r.randrange(len(t)), w)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {x.doc_id: x for x in toxicity.toxicity(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == (i % 5 == 0) for i in held)
    edge = toxicity.toxicity(odd, model).collect()
    assert len(edge) == 11 and all(0 <= x.score < 0.5 for x in edge)
    assert toxicity.toxicity(none, model).count() == 0
    blank = toxicity.fit(none, marks)
    assert not len(blank.tokens) and toxicity.toxicity(odd, blank).count() == 11


def test_difference_balances():
    r = random.Random(6)
    for k in (1, 2, 5, 16):
        sizes = [r.randint(1, 900) for _ in range(12 * k)]
        window, most = packing.difference(sizes, k)
        sums = Counter()
        for w, s in zip(window, sizes):
            sums[w] += s
        assert max(sums.values()) == most and len(sums) == k and max(sums.values()) - min(sums.values()) < 200


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    rows = [(i, words(random.Random(i).randint(0, 900), i)) for i in range(300)] + [(400, None), (401, ""), (402, words(9000, 2)), (403, "It's  <|endoftext|> don't,'s x's!?' É ﬁ Σ ΑΣ áb 12ab,c​d"), (404, "foo's, 'll <|x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = packing.packed(df, packing.Packing(vocabulary())).collect()
    docs, filled = {}, {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.start)):
        have = docs.setdefault(x.doc_id, [])
        assert x.start == len(have) and len(x.ids) == 4 * x.length
        have += np.frombuffer(x.ids, "<u4").tolist()
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, text in rows:
        assert docs[i] == [*t.encode(text or "", add_special_tokens=False).ids, 2]
    padding = total = 0
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * total
    assert packing.packed(none, packing.Packing(vocabulary())).count() == 0
    assert packing.packed(odd, packing.Packing(vocabulary())).where("start = 0").count() == 11


def whole(pieces):
    """What doesn't depend on partitions: by document the number of copies, and the tokens of all pieces."""
    got = Counter()
    for x in pieces.collect():
        got[x.doc_id, "copies"] += x.start == 0
        got[x.doc_id, "tokens"] += x.length
        got[x.doc_id, "size"] = max(got[x.doc_id, "size"], x.doc_tokens)
    return got


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and docs.count() <= before * (2 if name == "mix_sources" else 1)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.where("start = 0").count() == docs.count()
    assert whole(corpus_pipeline.run(spark, sf)) == whole(pieces)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_take_odd_rows_and_columns(spark, sf, odd, none, which):
    """Nulls, empty and long texts, repeated rows, clashing and quoted names, and an empty table."""
    import corpus_pipeline

    docs = {"odd": odd, "none": none}[which]
    docs = docs.withColumn("my col", F.lit(1)).withColumn("n_words", F.lit("mine")).withColumn("gone", F.lit(2)).withColumn("a.b`c", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema["n_words"].dataType.simpleString() == "string"
        rows = out.collect()
        if which == "none":
            assert not rows
        else:
            ids = Counter(x.doc_id for x in rows)
            assert {x["n_words"] for x in rows} == {"mine"} and {x["my col"] for x in rows} == {1} and {x["gone"] for x in rows} == {2}
            assert ids[1] >= 1 and ids[2] >= 1 or name == "mix_sources"
            assert name != "near_duplicates" or (5 not in ids and ids[4] == 2)
            assert name != "repeated_passages" or (len(rows) == 11 and {x.text for x in rows if x.doc_id == 5} == {""})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("start = 0").count() == docs.count()


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = words(60, 21), words(60, 22)
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " x"), (3, words(60, 23))], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in near_dedup.drop_near(df).collect()) == sorted([(1, a), (2, b), (3, words(60, 23))])
    got = Counter((x.doc_id, x.component_id) for x in near_dedup.near_components(df).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)])
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    rows = embedding_dedup.embedding_components(spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, label int")).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in rows) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)])
    report = licenses.license_report(spark.createDataFrame([(1, "cc by")] * 2500 + [(1, "cc")], "doc_id long, text string"))
    assert report.groupBy("base_labels").count().orderBy("count").collect() == [("", 1), ("cc-by", 2500)]
