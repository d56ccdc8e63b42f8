"""Templates of hosts: what every page has goes, whatever the host's size, and nothing else."""

from cuelake.llm import extraction

PAGE = "page_id long, url string, html string"


def texts(spark, bodies):
    got = extraction.extract(spark.createDataFrame([(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)], PAGE)).collect()
    return {r.page_id: r.text for r in got}


def test_root_text_goes_on_small_hosts_and_past_empty_pages(spark):
    body = lambda i: f"<article><p>Read our letter</p><p>own text {i}</p></article>"
    for n in (5, 19, 20):
        got = texts(spark, [body(i) for i in range(n)] + ["", None])
        assert got == {**{i: f"own text {i}" for i in range(n)}, n: "", n + 1: ""}


def test_only_what_all_pages_have_is_root(spark):
    """An early text of most pages stays in the article; a late one of all pages goes."""
    body = lambda i: f"<article>{'<p>copied to most</p>' if i % 4 else ''}<p>own text {i}</p><h2>early</h2><p>late root</p></article>"
    got = texts(spark, [body(i) for i in range(24)])
    assert got == {i: ("copied to most\n\n" if i % 4 else "") + f"own text {i}" for i in range(24)}


def test_a_template_of_any_size_keeps_its_last_tokens(spark):
    menu = "".join(f"<div>item {k}</div>" for k in range(2500))
    got = texts(spark, [f"<div>{menu}<p>own text {i}</p><p>foot of the page</p></div>" for i in range(4)])
    assert got == {i: f"own text {i}" for i in range(4)}


def test_copies_of_one_page_keep_their_article(spark):
    assert set(texts(spark, ["<article><p>the same on all</p></article>"] * 25).values()) == {"the same on all"}


def vectors(pages):
    """Occurrence vectors of each token over the pages, by counting."""
    from collections import Counter

    seqs = [extraction.page_tokens(p)[0] for p in pages]
    counts = [Counter(s) for s in seqs]
    return seqs, {t: tuple(c[t] for c in counts) for t in set().union(*counts)}


def brute_classes(pages, p):
    """Members of valid classes by their definition, from whole vectors and all pages at once."""
    seqs, vector = vectors(pages)
    n = sum(bool(s) for s in seqs)
    strong = {t: v for t, v in vector.items() if sum(map(bool, v)) >= max(p.pages, p.support * n)}
    signed = lambda t: t - (1 << 64) if t >> 63 else t
    place = {}
    for t in strong:
        at = [(s.index(t) + 1) / len(s) for s in seqs if t in s]
        place[t] = sum(at) / len(at)
    groups = {}
    for t, v in strong.items():
        groups.setdefault(v, []).append(t)
    root_vector = tuple(int(bool(s)) for s in seqs)
    roots = set(groups.get(root_vector, ()))
    out = set()
    for v, members in groups.items():
        members.sort(key=lambda t: (round(place[t], 9), signed(t)))
        slots, whole, bad = set(), True, set()
        for s in seqs:
            slot, got = 0, []
            for t in s:
                slot += t in roots
                if t in members:
                    got.append(members.index(t))
                    slots.add(slot)
            if max(v) == 1:
                kept = extraction._in_order([(k, i) for i, k in enumerate(got)])
                bad |= {members[k] for i, k in enumerate(got) if i not in kept}
            else:
                whole &= got == list(range(len(members))) * (len(got) // len(members))
        if whole and (v == root_vector or len(slots) == 1):
            out |= set(members) - bad
    return {signed(t) for t in out}


def random_pages(r, n):
    def some(k):
        return " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(k))

    pages = []
    for i in range(n):
        links = "".join(f"<li><a href=x>{some(1)}</a></li>" for _ in range(r.randint(2, 5)))
        parts = [f"<div><ul>{links}</ul></div>", f"<section><h2>{some(3)}</h2>{''.join(f'<p>{some(20)}</p>' for _ in range(r.randint(2, 6)))}<table><tr><td>{some(1)}</td></tr></table></section>", "<div>all rights kept</div>"]
        if r.random() < 0.6:
            parts.insert(r.choice([1, 1, 2]), f"<div><b>offer</b>{some(4)}</div>")
        if r.random() < 0.2:
            parts.reverse()
        pages.append(f"<body>{''.join(parts)}</body>")
    return pages


def test_valid_classes_equal_brute_force(spark):
    import random

    r = random.Random(12)
    p = extraction.Extraction()
    hosts = {f"h{k}": random_pages(r, r.randint(2, 14)) for k in range(8)}
    rows = [(h, k * 100 + i, page) for k, (h, pages) in enumerate(hosts.items()) for i, page in enumerate(pages)] + [("h0", 9999, None)]
    seqs = spark.createDataFrame(rows, "host string, key long, html string").repartition(3).mapInArrow(extraction._sequences, extraction.FACTS)
    got = {}
    for x in extraction.valid_members(seqs, extraction.token_classes(seqs, p)).collect():
        got.setdefault(x.host, set()).add(x.token)
    assert got == {h: brute_classes(pages, p) for h, pages in hosts.items()}
    assert any(len(v) > 8 for v in got.values())


def test_the_slot_is_found_without_any_names(spark):
    """Containers alone tell the article from menus, adverts and footers; without a template they don't."""
    import random

    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    want, bodies = {}, []
    for i in range(12):
        paragraphs = [words(r.choice([4, 30])) for _ in range(r.randint(1, 4))] if i else [words(3)]
        advert = f"<div>{words(12)}</div>" if i % 2 else ""
        bodies.append(f"<body><div><ul><li><a>{words(1)}</a></li></ul></div>{advert}<div><h1>{i} title</h1>{''.join(f'<p>{x}</p>' for x in paragraphs)}</div><div>{words(9)}</div></body>")
        want[i] = "\n\n".join([f"{i} title", *paragraphs])
    assert texts(spark, bodies) == want
    assert {i: extraction.main_text(b)[0] for i, b in enumerate(bodies)} != want


def _host(wrap, n=6):
    """Pages of one host: a menu and a footer that all share, and an article of its own within ``wrap``."""
    menu, foot = "<div><a href='/a'>Start</a> <a href='/b'>News</a></div>", "<div>All rights of this site belong to us, and to us alone.</div>"
    article = lambda i: f"<div><h1>Title {i}</h1><p>Text number {i} goes on and on, {'word ' * (20 + i)}.</p><p>It ends after {i * 7} words.</p></div>"
    return [(i, f"http://h.example/{i}", f"<html><body>{menu}{wrap[0]}{article(i)}{wrap[1]}{foot}</body></html>") for i in range(n)]


def test_the_classes_decide_whatever_the_names_around_the_slot_say(spark):
    for wrap in (("<div class='sidebar widget'>", "</div>"), ("<div id='comments'>", "</div>"), ("<div class='x'>", "</div>"), ("", "")):
        pages = spark.createDataFrame(_host(wrap), "page_id long, url string, html string")
        for r in extraction.extract(pages).collect():
            i = r.page_id
            assert r.text == f"Title {i}\n\nText number {i} goes on and on, {'word ' * (20 + i)}.\n\nIt ends after {i * 7} words.", wrap
    misled = spark.createDataFrame(_host(("<div class='sidebar widget'>", "</div>")), "page_id long, url string, html string")
    assert not any(r.text.startswith("Title") for r in extraction.extract(misled, extraction.Extraction(pages=10**9)).collect())


def test_names_within_the_slot_and_clashing_columns(spark):
    rows = [(i, u, h.replace("</h1>", "</h1><div class='advert'>Buy now, today only!</div>")) for i, u, h in _host(("<div class='layout-side'>", "</div>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = pages.selectExpr("*", "'x' AS text", "1 AS host", "2 AS slots", "3 AS n_template", "4 AS `key`", "5 AS tokens")
    got = {r.page_id: r.text for r in extraction.extract(more).collect()}
    assert len(got) == 6 and all(t.startswith(f"Title {i}\n\nText number") and "Buy" not in t for i, t in got.items())


def test_very_long_pages(spark):
    rows = [(i, f"http://long.example/{i}", "<html><body><nav><a>Menu</a></nav><article><h1>T" + f"{i}</h1>" + "<p>" + f"w{i} " * 10 + "</p>" + f"<p>{f'lang{i} ' * 20_000}</p>" * 3 + "<div>" * 600 + "deep" + "</div>" * 600 + "</article></body></html>") for i in range(3)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.count("lang") == 60_000 and t.startswith(f"T{i}\n\n") and "Menu" not in t for i, t in got.items())
