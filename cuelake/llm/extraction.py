"""HTML extraction by equivalence classes of tokens and a nested template of each host.

Pages of a host are read as sequences of tokens: opened elements, told apart by their path of names
from the root and by what comes first in them, and the texts in them. Each token has an occurrence
vector over the host's pages (how often it stands on which), summed up as a hash by partial
aggregates, so that no host's pages need to meet in one task. Tokens with one vector are a class.
A class is valid if its tokens stand in one order on every page and, unless it is the class of what
every page has once, always in the same slot between tokens of that class. Valid classes are the
host's template: elements that stand once are its slots' containers, texts that all pages have are
its own, and the article is what fills the container that holds most of the host's running text.
Names of elements and classes only choose between containers, and say what within one is left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WHITE = re.compile(r"[\s\x00]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Fixed values of HTML: elements without end tag, with raw text, of blocks, and what closes a <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form button select option dialog menu svg object canvas audio video label input".split()) | RAW
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widgets?|footer|topbar"
    r"|comments?|commentlist|respond|reply|replies|discuss\w*|disqus\w*|cookies?|cookiebar|consent|gdpr|notices?|notification\w*|alert\w*|newsletter\w*|subscri\w*|signup|sign-up|login|log-in"
    r"|social|share|sharing|sharebar|related|recommend\w*|popular|trending|pagination|pager|popup\w*|modal\w*|overlay|toolbar|copyright|legal|disclaimer|skip-link|hidden|search\w*)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body)(?:[\s_-]?(?:body|content|text|article))?(?:$|[\s_-])", re.I)


#: Elements around a text that are told apart.
DEEP = 256


@dataclass(frozen=True)
class Extraction:
    """pages: least number of pages for a template. text_pages: and for its texts. support: least share of
    a host's pages on which a class stands. dense: share of the running text that a container holds.

    Pages without any token don't count.
    """

    pages: int = 2
    text_pages: int = 3
    support: float = 0.5
    dense: float = 0.6


class Node:
    """A text run: its block, the tokens around it, how many elements were opened before it, and what its ancestors say of it."""

    __slots__ = ("text", "block", "around", "at", "main", "out", "link", "gone")

    def __init__(self, text, block, around, at, main, out, link, gone):
        self.text, self.block, self.around, self.at, self.main, self.out, self.link, self.gone = text, block, around, at, main, out, link, gone

    def token(self) -> int:
        return hash_text(f"{self.around[-1] if self.around else 0}\x00{_squeeze(self.text)}") | 1


class Element:
    """An open element. Its token is known once its first child is."""

    __slots__ = ("tag", "names", "main", "out", "link", "gone", "token", "around")

    def __init__(self, tag, names, main, out, link, gone):
        self.tag, self.names, self.main, self.out, self.link, self.gone, self.token, self.around = tag, names, main, out, link, gone, None, ()


def _look(tag: str, attributes: str, main: int) -> tuple[str, int, bool]:
    """(class and id names, main depth, left out by its own names) of an element below ``main``."""
    names, role, gone = "", "", False
    if attributes:
        for m in NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                gone = True
    gone = gone or tag in LEFT_OUT or role in LEFT_OUT_ROLES or (tag == "header" and not main)
    if tag not in ("html", "body", "article", "main", "h1") and names and (LEFT_OUT_NAMES.search(names.strip()) or main < 2 and HEADER_NAMES.search(names.strip())):
        gone = True  # an article's own header holds its title
    if tag in ("article", "main") or role in ("main", "article"):
        main = max(main, 3 if tag == "article" or role == "article" else 2)
    elif names and MAIN_NAMES.search(names.strip()):
        main = max(main, 1)
    return names, main, gone


def parse(page: str) -> tuple[list[Node], list[tuple[int, int]]]:
    """(text runs in order, (token, mark) of opened elements in order); broken markup is read as far as it goes.

    A mark is -1 for what is left out by its names, else how clearly they say main text.
    """
    nodes: list[Node] = []
    opened: list[tuple[int, int]] = []
    top = Element("", "", 0, False, False, -1)
    top.token = 0
    stack = [top]
    block, at, n = 0, 0, len(page)

    def first_child(kind: str):
        x = stack[-1]
        if x.token is None:
            parent = stack[-2]
            x.token = hash_path(parent.token, x.tag, x.names, kind)
            # what is nested deeper than any layout counts for its outer elements
            x.around = (*parent.around, x.token) if len(parent.around) < DEEP else parent.around
            opened.append((x.token, -1 if x.out else x.main))

    def text(raw: str):
        if raw and not raw.isspace():
            first_child("#")
            x = stack[-1]
            nodes.append(Node(entities.unescape(raw) if "&" in raw else raw, block, x.around, len(opened), x.main, x.out, x.link, x.gone))
        elif raw and nodes and nodes[-1].block == block:
            nodes[-1].text += " "

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        elif tag == "br" and nodes and nodes[-1].block == block:
            nodes[-1].text += " "
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    first_child("")
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "table", "td") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before
                open_tag = stack[k].tag
                if open_tag == "p" or open_tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    first_child("")
                    del stack[k:]
                    break
                if open_tag in BLOCK:
                    break
        first_child(tag)
        x = stack[-1]
        names, main, gone = _look(tag, m[3], x.main)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        # gone: how deep the innermost element stands that is left out by its names
        stack.append(Element(tag, names, main, x.out or gone, x.link or tag == "a", len(x.around) if gone else x.gone))
    return nodes, opened


DIGITS = re.compile(r"\d+")


def hash_path(path: int, tag: str, names: str, first: str) -> int:
    """The token of an element: an even number; that of a text is odd."""
    key = (path, tag, names, first)
    if key not in _PATHS:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[key] = hash_text(f"{path} {tag} {DIGITS.sub('#', names)} {first}") & ~1
    return _PATHS[key]


_PATHS: dict[tuple, int] = {}


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _squeeze(text: str) -> str:
    return WHITE.sub(" ", text).strip()


def page_tokens(page: str) -> tuple[list[int], dict[int, list]]:
    """(tokens in order, by token: [times, place, running text, link text, mark, blocks]) of a page, whatever names say of the text.

    blocks: how many changes of block its texts see; an element without any is a block itself.
    """
    nodes, opened = parse(page)
    marks = dict(opened)
    seq: list[int] = []
    facts: dict[int, list] = {}
    at = 0
    for x in [*nodes, None]:
        until = len(opened) if x is None else x.at
        seq += [t for t, _ in opened[at:until]]
        at = until
        if x is not None:
            seq.append(x.token())
    for place, token in enumerate(seq, 1):
        if token in facts:
            facts[token][0] += 1
        else:
            facts[token] = [1, place, 0, 0, 0, 0]
    last: dict[int, int] = {}
    for x in nodes:
        for token in set(x.around):
            facts[token][3 if x.link else 2] += len(x.text)
            facts[token][5] += last.setdefault(token, x.block) != x.block
            last[token] = x.block
    for token, fact in facts.items():
        fact[1] /= len(seq)
        fact[4] = marks.get(token, 0)
    return seq, facts


def _sequences(batches):
    """host, key, tokens of each page: what later passes read instead of the page; and its facts by token."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            seqs, facts = [], []
            for page in part.column(2):
                seq, fact = page_tokens(page.as_py() or "")
                seqs.append(np.array(seq, np.uint64).view(np.int64))
                facts.append(np.array([(t, *f) for t, f in fact.items()], object).reshape(-1, 7))
            sizes = np.cumsum([0, *map(len, seqs)])
            fact_sizes = np.cumsum([0, *map(len, facts)])
            flat = np.concatenate([*facts, np.empty((0, 7), object)])
            listed = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            own = pa.StructArray.from_arrays(
                [pa.array(flat[:, 0].astype(np.uint64).view(np.int64)), *(pa.array(flat[:, k].astype(t)) for k, t in ((1, np.int32), (2, np.float32), (3, np.int32), (4, np.int32), (5, np.int32), (6, np.int32)))],
                ["token", "times", "place", "running", "linked", "mark", "blocks"],
            )
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed(pa.array(np.concatenate([*seqs, np.empty(0, np.int64)])), sizes), listed(own, fact_sizes)], ["host", "key", "tokens", "facts"])


FACTS = "host string, key long, tokens array<long>, facts array<struct<token:long,times:int,place:float,running:int,linked:int,mark:int,blocks:int>>"


def _vectors(batches):
    """host, token and sums over some pages: support, occurrences, vector, place, running and link text, blocks, mark.

    A null token has the number of pages with tokens and, as its occurrences, how many tokens they have.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: dict[tuple[str, int | None], list] = {}
            for host, key, facts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if not len(facts):
                    continue
                cols = [x.to_numpy().tolist() for x in facts.values.flatten()]
                whole = rows.setdefault((host, None), [0, 0, 0, 0.0, 0, 0, 0, 0])
                whole[0] += 1
                whole[1] += len(cols[0])
                for token, times, place, running, linked, mark, blocks in zip(*cols):
                    got = rows.setdefault((host, token), [0, 0, 0, 0.0, 0, 0, 0, mark])
                    got[0] += 1
                    got[1] += times
                    got[2] = (got[2] + hash((key, times)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                    got[3] += place
                    got[4] += running
                    got[5] += linked
                    got[6] += blocks
            if rows:
                names = [k[1] for k in rows]
                cols = list(zip(*rows.values()))
                arrays = [pa.array([k[0] for k in rows]), pa.array(names, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.array(cols[2], np.uint64).view(np.int64)), pa.array(cols[3], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[4:])]
                yield pa.RecordBatch.from_arrays(arrays, ["host", "token", "support", "times", "vector", "place", "running", "linked", "blocks", "mark"])


def order_faults(seq: list[int], classes: list[tuple[int, bool, bool, list[int]]]):
    """What speaks against classes (id, root, single, tokens in order) on a page of tokens ``seq``.

    (class, token or null for all of it, slots of the root class it stands in: least and most, fault).
    """
    rank = {t: (c, k) for c, (_, _, _, tokens) in enumerate(classes) for k, t in enumerate(tokens)}
    found: list[list[tuple[int, int, int]]] = [[] for _ in classes]  # place, member, slot
    slot = 0
    for i, t in enumerate(seq):
        if (r := rank.get(t)) is not None:
            slot += classes[r[0]][1]
            found[r[0]].append((i, r[1], slot))
    for (cid, root, single, tokens), got in zip(classes, found):
        if not got:
            continue
        slots = [s for *_, s in got]
        yield cid, None, min(slots), max(slots), 0
        if single:
            kept = _in_order([(k, i) for i, k, _ in got])
            for i, k, _ in got:
                if i not in kept:
                    yield cid, tokens[k], 0, 0, 1
        elif [k for _, k, _ in got] != list(range(len(tokens))) * (len(got) // len(tokens)):
            yield cid, None, min(slots), max(slots), 1


def _checker(batches):
    """The faults of each host's classes, added up over a batch's pages."""
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        held: tuple[str | None, list] = (None, [])
        hosts = batch.column(0).to_pylist()
        for i, host in enumerate(hosts):
            if host != held[0]:
                held = (host, [(c["cid"], c["root"], c["single"], c["tokens"]) for c in batch.column(2)[i].as_py()])
            for cid, token, lo, hi, fault in order_faults(batch.column(1)[i].values.to_numpy().tolist(), held[1]):
                got = rows.setdefault((host, cid, token), [1 << 30, 0, 0])
                got[0], got[1], got[2] = min(got[0], lo), max(got[1], hi), got[2] + fault
        if rows:
            keys, sums = list(zip(*rows)), list(zip(*rows.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), *(pa.array(k, pa.int64()) for k in keys[1:]), *(pa.array(x, pa.int64()) for x in sums)], ["host", "cid", "token", "lo", "hi", "faults"])


def token_classes(seqs: DataFrame, p: Extraction) -> DataFrame:
    """host, pages, same, cid, root, single, members of each class; members are in the order of mean places."""
    vectors = seqs.select("host", "key", "facts").mapInArrow(_vectors, "host string, token long, support long, times long, vector long, place double, running long, linked long, blocks long, mark long")
    # vectors are added modulo 2**64: as two halves, which cannot overflow a long
    low, high = F.sum(F.expr("vector & 4294967295L")), F.sum(F.expr("shiftrightunsigned(vector, 32)"))
    add = lambda c: F.sum(c).alias(c)
    tokens = vectors.groupBy("host", "token").agg(add("support"), add("times"), low.alias("v0"), high.alias("v1"), add("place"), add("running"), add("linked"), add("blocks"), F.max("mark").alias("mark"))
    tokens = saved(tokens.where((F.col("support") >= p.pages) | F.col("token").isNull()), "tokens")
    per_host = tokens.where("token is null").select("host", F.col("support").alias("pages"), F.col("times").alias("total"))
    strong = tokens.where("token is not null").join(per_host, "host").where(F.col("support") >= p.support * F.col("pages"))
    member = F.struct((F.col("place") / F.col("support")).alias("place"), "token", "running", "linked", "blocks", "mark")
    vector = ["host", "pages", "total", "support", "times", "v0", "v1"]
    classes = strong.groupBy(*vector).agg(F.array_sort(F.collect_list(member)).alias("members"))
    single = F.col("times") == F.col("support")
    everywhere = F.sum(F.when(F.col("support") == F.col("pages"), F.col("support") * F.size("members")).otherwise(0)).over(Window.partitionBy("host"))
    return saved(
        classes.select("host", "pages", (everywhere == F.col("total")).alias("same"), F.xxhash64("support", "times", "v0", "v1").alias("cid"), (single & (F.col("support") == F.col("pages"))).alias("root"), single.alias("single"), (F.col("support") == F.col("pages")).alias("everywhere"), "members"),
        "classes",
    )


def valid_members(seqs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes' members, one a row, that no page speaks against: ordered and, but for the root class, in one slot of it."""
    one = F.struct("cid", "root", "single", F.transform("members", lambda m: m["token"]).alias("tokens"))
    by_host = classes.groupBy(F.col("host").alias("h")).agg(F.collect_list(one).alias("classes"))
    # both sides by host and the pages of a host together, so that a batch reads its classes once
    met = seqs.select("host", "tokens").join(by_host, F.col("host") == F.col("h")).select("host", "tokens", "classes")
    faults = met.mapInArrow(_checker, "host string, cid long, token long, lo long, hi long, faults long").groupBy("host", "cid", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("faults").alias("faults"))
    faults = saved(faults, "faults")
    whole = faults.where("token is null").select("host", "cid", "lo", "hi", F.col("faults").alias("class_faults"))
    parts = faults.where("token is not null").select("host", "cid", "token", F.col("faults").alias("token_faults"))
    d = classes.join(whole, ["host", "cid"]).where(F.col("root") | (F.col("lo") == F.col("hi"))).where("class_faults = 0")
    d = d.select("host", "pages", "same", "cid", "root", "single", "everywhere", F.explode("members").alias("m")).select("*", "m.*").drop("m")
    return d.join(parts, ["host", "cid", "token"], "left").where("coalesce(token_faults, 0) = 0")


def templates(pages: DataFrame, p: Extraction = Extraction()) -> DataFrame:
    """host, slots (containers of the main text), fixed (texts of the template), lists (elements that hold links), template.

    From (host, key, html) rows. A container is a token of a valid class, once on a page, whose texts are of
    several blocks. The slot is the innermost one that holds ``dense`` of the running text of all, whatever
    its name. Of containers that hold more than what ``dense`` leaves, text alone cannot tell where the slot
    ends: if one is named main text, the clearest name decides between these. Pages that are all alike don't
    tell what is template: their host has no fixed texts.
    """
    seqs = saved(pages.select("host", "key", "html").mapInArrow(_sequences, FACTS), "sequences")
    valid = valid_members(seqs, token_classes(seqs, p))
    is_text = F.col("token").bitwiseAND(F.lit(1)) == 1
    d = valid.withColumn("holds", ~is_text & F.col("single") & (F.col("running") > 0) & (F.col("blocks") > 0))
    w = Window.partitionBy("host")
    d = d.withColumn("most", F.max(F.when(F.col("holds"), F.col("running"))).over(w))
    share = F.when(F.col("holds"), F.col("running") / F.col("most"))
    d = d.withColumn("deep", F.when(share >= p.dense, F.col("place")))
    d = d.withColumn("named", F.when((share > 1 - p.dense) & (F.col("mark") >= 2), F.col("mark"))).withColumn("clearest", F.max("named").over(w))
    fixed = is_text & F.col("everywhere") & ~F.col("same") & (F.col("pages") >= p.text_pages)
    lists = ~is_text & (F.col("linked") > F.col("running")) & F.col("clearest").isNull()
    some = lambda c: F.collect_set(F.when(c, F.col("token")))
    out = d.groupBy("host").agg(some(F.col("named") == F.col("clearest")).alias("named"), F.max_by("token", "deep").alias("inner"), some(fixed).alias("fixed"), some(lists).alias("lists"), F.collect_set("token").alias("template"))
    return out.select("host", F.when(F.size("named") > 0, F.col("named")).otherwise(F.array_compact(F.array("inner"))).alias("slots"), "fixed", "lists", "template")


NONE: frozenset[int] = frozenset()


def main_text(page: str, slots: frozenset[int] = NONE, fixed: frozenset[int] = NONE, lists: frozenset[int] = NONE, template: frozenset[int] = NONE, dense: float = 0.6) -> tuple[str, int]:
    """(the main text, template tokens matched) of a page under its host's template.

    What fills the template's slot is the text, less the template's own texts and elements within the slot
    that their names leave out; what stands around the slot is not asked. A page that has no such container
    is its own template: names choose the container, else the innermost element that holds ``dense`` of the
    page's running text.
    """
    nodes, opened = parse(page)
    tokens = [x.token() for x in nodes] if template else []
    matched = sum(t in template for t, _ in opened) + sum(t in template for t in tokens)
    inside = [_fills(x, slots) for x in nodes]
    level = 0
    if not any(inside):
        level = max((x.main for x in nodes if not x.out), default=0)
        inside = [x.main >= level for x in nodes] if level >= 2 else _held(nodes, opened, dense)
        inside = [k and not x.out for k, x in zip(inside, nodes)]
    kept = [x for i, x in enumerate(nodes) if inside[i] and not (fixed and tokens[i] in fixed) and lists.isdisjoint(x.around)]
    if level < 2:
        kept = _dense(kept) if not any(x.main >= 2 for x in kept) else kept
    blocks: list[tuple[int, list[str]]] = []
    for x in kept:
        if blocks and blocks[-1][0] == x.block:
            blocks[-1][1].append(x.text)
        else:
            blocks.append((x.block, [x.text]))
    texts = (_squeeze("".join(parts)) for _, parts in blocks)
    return "\n\n".join(t for t in texts if t), matched


def _fills(x: Node, slots: frozenset[int]) -> bool:
    """Whether a text stands in a slot and no element between them is left out by its names."""
    depth = next((k for k, t in enumerate(x.around) if t in slots), None)
    return depth is not None and x.gone <= depth


def _held(nodes: list[Node], opened: list[tuple[int, int]], dense: float) -> list[bool]:
    """Which texts the innermost element with ``dense`` of the running text holds; elements that repeat don't count."""
    running: dict[int, int] = {}
    total = 0
    for x in nodes:
        if not x.out and not x.link:
            total += len(x.text)
            for t in x.around:
                running[t] = running.get(t, 0) + len(x.text)
    times: dict[int, int] = {}
    for t, _ in opened:
        times[t] = times.get(t, 0) + 1
    inner = None
    for t, _ in opened:
        if times[t] == 1 and running.get(t, 0) >= dense * total > 0:
            inner = t
    return [inner is None or inner in x.around for x in nodes]


def _in_order(spots: list[tuple[int, int]]) -> set[int]:
    """Indices of a longest run of template tokens whose places do not fall."""
    ends, at, back = [], [], {}
    for place, i in spots:
        k = bisect_right(ends, place)
        back[i] = at[k - 1] if k else None
        if k == len(ends):
            ends.append(place)
            at.append(i)
        else:
            ends[k], at[k] = place, i
    out, i = set(), at[-1] if at else None
    while i is not None:
        out.add(i)
        i = back[i]
    return out


def _dense(nodes: list[Node]) -> list[Node]:
    """Without an article element: what stands below content names if anything does, less blocks of links."""
    if any(x.main for x in nodes):
        nodes = [x for x in nodes if x.main]
    words: dict[int, list[int]] = {}
    for x in nodes:
        got = words.setdefault(x.block, [0, 0])
        got[x.link] += len(x.text)
    return [x for x in nodes if words[x.block][1] <= words[x.block][0]]


def _extractor(p: Extraction):
    def extracted(batches):
        held: tuple[str | None, tuple[frozenset[int], ...]] = (None, ())
        for batch in batches:
            hosts, pages = batch.column(0), batch.column(1)
            texts, matched = [], []
            for i in range(batch.num_rows):
                host = hosts[i].as_py()
                if host != held[0]:
                    sets = (batch.column(k)[i] for k in (2, 3, 4, 5))
                    held = (host, tuple(frozenset(np.asarray(x.values).view(np.uint64).tolist()) if x.is_valid and len(x) else NONE for x in sets))
                text, n = main_text(pages[i].as_py() or "", *held[1], dense=p.dense)
                texts.append(text)
                matched.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6, batch.num_columns)), pa.array(texts, pa.string()), pa.array(matched, pa.int64())], names=[*batch.schema.names[6:], "text", "n_template"])

    return extracted


def extract(pages: DataFrame, p: Extraction = Extraction()) -> DataFrame:
    """page_id, url, text, n_template (template tokens matched) of every page.

    A null html counts as empty and gives an empty text; a null url is a host of its own, "". Pages
    of hosts with fewer than ``pages`` pages are read by themselves. Repeated rows give equal rows. An
    empty table gives no rows. Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = pages.select("page_id", "url", "html", host.alias("host"))
    found = saved(templates(known.select("host", F.xxhash64("url", "page_id").alias("key"), "html"), p), "templates")
    joined = known.join(found.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left")
    kinds = dict(pages.dtypes)
    return joined.select("host", "html", "slots", "fixed", "lists", "template", "page_id", "url").mapInArrow(_extractor(p), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_template long")
