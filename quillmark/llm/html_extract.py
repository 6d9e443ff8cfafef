"""Operator 5: main text of web pages by equivalence-class template deduction.

1. Each page is parsed once, in time linear in its length, into elements. An element's path (tag and first class, id or role, from
   the root) is a token, kept as a 64-bit hash with its parent's. A token's occurrence vector over the pages of a host is kept as
   a fingerprint, the sum over pages of mix(page, count), which adds up in any order. All sums are combined map-side, so a
   host with a third of all pages costs a few rows for each task.
2. Tokens of a host with equal vectors, one occurrence on each of their pages, form an equivalence class. A class is valid if its
   tokens nest (each one's parent is in a class too), and it has CLASS tokens and LEAST pages, or is on all pages: each is a
   layout. A page is of the layout with the fewest pages among those whose tokens it has, else of the host's rest.
   Tokens on fewer than LEAST pages or RARE of them are in no class; in step 3 their text counts for the nearest element that is.
3. In a second pass vectors and sums are taken for each layout by itself. Its valid classes (on all of its pages, or CLASS
   tokens on SUPPORT of them) nest into the layout's template; what varies lies in the slots between its tokens. The
   slot with the most unlinked text that differs between pages is the article's, its innermost template token the container; an
   article or main around it is taken instead. Templates are small rows (host, and each layout's container and fixed paths).
4. Each page's blocks inside the container are extracted, without elements that are menus, notices, forms or comments by their
   own meaning. Where the container is no element of the article's own but the body, slots beside the article's in which
   all pages repeat the same text go too; nothing else does.

Templates join pages on the host: broadcast if their measured size is under BROADCAST_BYTES, else a shuffled join over
salted hosts. A host with fewer than LEAST pages has no occurrence vectors to compare; its pages use the elements'
meanings alone (article, main, else the densest block container).

Defined results: null and empty html have an empty text and 0 characters; a null url belongs to the host '', a null page_id is kept;
very long pages are taken whole; unclosed and cut-off markup is closed at its parent's or the page's end, a quote that never
closes ends with its tag; of slots of equal size the one with the greater hash is taken; repeated rows are pages of their own, but
templates come from a host's different pages, so equal html counts once for them; an empty table gives no rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import BROADCAST_BYTES, Kept, bounded, cut, table, text_batches
from quillmark.llm.url_filter import host_path

LEAST = 3
SUPPORT = 0.5
#: Least tokens of an equivalence class that isn't on all pages.
CLASS = 3
SALTS = 32
#: Least share of a host's pages that a class is on. A host has at most 1 / RARE times a page's tokens in classes, so its rows can be gathered.
RARE = 0.01
#: Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
NEVER = frozenset("script style noscript template iframe nav header footer aside form button select textarea input dialog menu head title svg canvas object".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "select")
WHOLE = frozenset("html body article main".split())
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote".split())
#: Words that name what is no article, and words that say nothing beside them. A name counts if all its words are of these and one is of the first.
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo related replies share sharing sidebar social sponsor sponsored subscribe widget".split())
BESIDE = frozenset("area bar block bottom box button buttons container content footer global group inner item items left link links list main media outer page panel reader readers right section side site slot teaser text top unit user users wrap wrapper".split())
NAME = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))", re.I)
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
WORDS = re.compile(r"[a-z]+")


def named_bad(name: str) -> bool:
    words = WORDS.findall(name)
    return any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words)


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, bool]:
    """(mark of an element, whether it is by its own meaning no part of an article)."""
    names = {k.lower(): (a or b or c).lower().split() for k, a, b, c in NAME.findall(attributes)} if "=" in attributes else {}
    own = names.get("class") or names.get("id") or names.get("role") or ()
    bad = tag in NEVER or tag not in WHOLE and any(named_bad(w) for k in ("class", "id", "role") for w in names.get(k, ()))
    return f"{tag}.{own[0]}" if own else tag, bad


def _mix(a: int, b: int) -> int:
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


def _part(page: int, n: int) -> int:
    return (_mix(page, n) & 0xFFFFFFFFFF) - (1 << 39)  # 40 bits: sums of 2^23 pages stay exact


@lru_cache(maxsize=65536)
def _key(up: int, mark: str) -> int:
    x = _mix(up, zlib.crc32(mark.encode("utf-8", "replace")) | len(mark) << 32)
    return x - (1 << 64) if x >> 63 else x


class Node:
    """An open element: its path's hash, its parent, and what follows from the elements around it."""

    __slots__ = ("key", "up", "tag", "mark", "depth", "bad", "out", "block", "article", "linked")

    def __init__(self, up, tag: str, mark: str, bad: bool):
        self.up, self.tag, self.mark = up, tag, mark
        self.key, self.depth = _key(up.key if up else 0, mark), up.depth + 1 if up else 0
        self.article = self if tag in ("article", "main") else up.article if up else None
        self.bad = bad and not (tag == "header" and self.article is not None and self.article.tag == "article")  # the article's own holds its title
        self.out = self.bad or bool(up and up.out)
        self.block = up.block if tag in INLINE and up else self
        self.linked = tag == "a" or bool(up and up.linked)


#: What is around all elements of a page; it is never opened.
ROOT = Node(None, "", "", False)


def walk(page: str):
    """(node, opens, text): an element's begin (opens, text '') or a piece of text inside an element (ROOT outside of all)."""
    stack = [ROOT]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    blocks: list[int] = []  # of those that aren't inline
    last = {q: page.rfind(q) for q in "\"'"}
    at = 0

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
            if blocks and blocks[-1] >= len(stack):
                blocks.pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < len(page):
        m = OPEN.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at:
            yield stack[-1], False, entities.unescape(page[at:begin])
        if not m:
            return
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = TAG.match(page, begin + 1)
        if not m:  # a declaration or a stray mark
            end = page.find(">", begin)
            at = end + 1 if end >= 0 else len(page)
            continue
        at = m.end()
        while True:  # to the tag's end, over quoted values
            stop = STOP.search(page, at)
            if not stop:
                return  # cut off inside a tag
            at = stop.end()
            quote = stop[0]
            if quote == ">":
                break
            if page[m.end():stop.start()].rstrip()[-1:] != "=":
                continue  # no value begins here
            if last[quote] < at:
                end = page.find(">", at)  # it never closes
                if end < 0:
                    return
                at = end + 1
                break
            at = page.find(quote, at) + 1
        attributes = page[m.end():at - 1]
        tag = m[2].lower()
        if m[1]:
            k = innermost((tag,))
            if k >= 0 and not (tag in INLINE and blocks and blocks[-1] > k):
                close(k)
            continue
        if tag in ENDS_P and (k := innermost(("p",))) >= 0:
            close(k)
        if tag in CLOSES and (k := innermost(CLOSES[tag])) > innermost(SCOPES):
            close(k)
        node = Node(stack[-1], tag, *_marks(tag, attributes))
        yield node, True, ""
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
            end = page.find(">", end.start()) if end else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(node)


def _paged(pages: DataFrame) -> DataFrame:
    host, _ = host_path(F.col("url"))
    return pages.select(F.xxhash64("page_id", "url").alias("row"), host.alias("host"), F.col("html").cast("string").alias("html"))


def _different(rows: DataFrame) -> DataFrame:
    """rows with equal html of a host once. Only html that is repeated is shuffled, combined map-side; the rest stays where it is."""
    keyed = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({"a": F.xxhash64("html"), "b": F.xxhash64(F.lit(1), "html")})
    again = bounded(Kept(keyed.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("host", "a", "b", F.lit(True).alias("again")), 96))
    marked = keyed.join(again, ["host", "a", "b"], "left")
    copies = cut(marked.where("again").groupBy("host", "a", "b").agg(F.min("row").alias("row"), F.min("html").alias("html")))
    return marked.where("again IS NULL").select("row", "host", "html").union(copies.select("row", "host", "html"))


def _with(rows: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """rows with their host's row of found: broadcast if its size is under BROADCAST_BYTES, else over salted hosts."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def _bytes(found: DataFrame, *columns: str) -> int:
    return found.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in columns), F.lit(64))), F.lit(0))).first()[0]


def structure(rows: DataFrame) -> DataFrame:
    """(host, key, up, depth, fine, pages, n, print): each token with the sums of its occurrence vector over its host's pages; key 0 is the page itself."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            for page_id, host, page in zip(batch["row"], batch["host"], batch["html"]):
                count: dict[int, int] = {}
                nodes: dict[int, Node] = {}
                for node, opens, _ in walk(page or ""):
                    if opens:
                        nodes[node.key] = node
                        count[node.key] = count.get(node.key, 0) + 1
                for key, n in [(0, 1), *count.items()]:
                    node = nodes.get(key)
                    s = seen.get((host, key))
                    if s is None:
                        s = seen[host, key] = [node.up.key if node else 0, node.depth if node else 0, not (node and node.out), 0, 0, 0]
                    s[3] += 1
                    s[4] += n
                    s[5] += _part(int(page_id), n)
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns="host key up depth fine pages n print".split())

    parts = rows.mapInPandas(run, "host string, key long, up long, depth int, fine boolean, pages long, n long, print long")
    return parts.groupBy("host", "key").agg(F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("fine").alias("fine"), *(F.sum(c).alias(c) for c in ("pages", "n", "print")))


def nested(tokens: list[tuple], least: float, total: int) -> tuple[set[int], dict[tuple[int, int], list[int]]]:
    """(template, classes) of tokens (key, up, depth, fine, pages, n, print): valid classes by (pages, print), and all their tokens that nest.

    Tokens with equal vectors and one occurrence on each of their pages, at least `least`, are a class; it is valid with CLASS tokens that
    nest, or on all pages.
    """
    classes: dict[tuple[int, int], list[int]] = {}
    once = {t[0]: t for t in tokens if t[0] and t[4] == t[5] >= least and t[3]}
    inside: set[int] = set()
    for key, up, depth, *_ in sorted(once.values(), key=lambda t: (t[2], t[0])):
        if depth == 1 or up in inside:
            inside.add(key)
            classes.setdefault((once[key][4], once[key][6]), []).append(key)
    classes = {v: ks for v, ks in classes.items() if len(ks) >= CLASS or v[0] == total}
    valid = {k for ks in classes.values() for k in ks}
    template: set[int] = set()
    for key in sorted(valid, key=lambda k: (once[k][2], k)):
        if once[key][2] == 1 or once[key][1] in template:
            template.add(key)
    return template, classes


def layouts_of(tokens: list[tuple]) -> list[int]:
    """A token of each layout of one host: those on the fewest pages first."""
    total = next((t[4] for t in tokens if t[0] == 0), 0)
    _, classes = nested(tokens, LEAST, total)
    return [ks[0] for _, ks in sorted(classes.items(), key=lambda c: (c[0][0], -len(c[1]), c[1][0]))]


def layouts(rows: DataFrame) -> DataFrame:
    """(host, layouts, kept): the layouts' tokens, and those that may be in a class."""
    found = cut(structure(rows))
    total = found.where("key = 0").select("host", F.col("pages").alias("total"))
    kept = found.join(total, "host").where((F.col("key") == 0) | (F.col("pages") >= F.greatest(F.lit(float(LEAST)), RARE * F.col("total"))))

    def run(key, rows):
        each = list(rows[["key", "up", "depth", "fine", "pages", "n", "print"]].itertuples(index=False, name=None))
        return pd.DataFrame([(key[0], layouts_of(each), sorted(t[0] for t in each if t[0]))], columns=["host", "layouts", "kept"])

    return kept.groupBy("host").applyInPandas(run, "host string, layouts array<bigint>, kept array<bigint>")


def layout_of(keys, layouts) -> int:
    """The first of the layouts that a page is of, 0 for none."""
    return next((k for k in layouts if k in keys), 0)


def _sums(page_id: int, page: str, kept) -> dict[tuple[int, bool], list]:
    """{(key, folded): [up, depth, fine, kind, count, fingerprint part, text size, linked size, text hash]} of a page's kept tokens.

    Text of other tokens is folded into the nearest kept one around it, unless it is in a menu, notice or the like.
    """
    found: dict[tuple[int, bool], list] = {}

    def at(node: Node, folded: bool) -> list:
        s = found.get((node.key, folded))
        if s is None:
            up = node.up
            while up and up.key not in kept:
                up = up.up
            kind = 2 if node.tag in ("article", "main") else 1 if node.tag in ("html", "body") else 0
            s = found[node.key, folded] = [up.key if up else 0, node.depth, not node.out, kind, 0, 0, 0, 0, 0]
        return s

    for node, opens, text in walk(page):
        if opens:
            if node.key in kept:
                at(node, False)[4] += 1
            continue
        text = text.strip()
        if not text:
            continue
        own = node.block  # inline elements' text belongs to the block around them
        if own.key not in kept:
            if node.out:
                continue
            while own and own.key not in kept:
                own = own.up
            if own is None:
                continue
            s = at(own, True)
            s[4] = 1
        else:
            s = at(own, False)
        s[6] += len(text)
        s[7] += len(text) * node.linked
        s[8] = zlib.crc32(text.encode("utf-8", "replace"), s[8])
    for s in found.values():
        s[5] = _part(page_id, s[4])
    return found


def tokens(rows: DataFrame) -> DataFrame:
    """One row per (host, layout, key, folded) with its sums over the layout's pages."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            for page_id, host, page, known, kept in zip(batch["row"], batch["host"], batch["html"], batch["layouts"], batch["kept"]):
                found = _sums(int(page_id), page or "", frozenset(kept) if kept is not None else frozenset())
                layout = layout_of({k for k, folded in found if not folded}, known.tolist() if known is not None else [])
                for (key, folded), (up, depth, fine, kind, n, part, size, linked, digest) in [*found.items(), ((0, False), (0, 0, True, 0, 1, 0, 0, 0, 0))]:
                    s = seen.get((host, layout, key, folded))
                    if s is None:
                        seen[host, layout, key, folded] = [up, depth, fine, kind, 1, n, part, size, linked, digest, digest]
                    else:
                        s[4] += 1
                        s[5] += n
                        s[6] += part
                        s[7] += size
                        s[8] += linked
                        s[9], s[10] = min(s[9], digest), max(s[10], digest)
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns="host layout key folded up depth fine kind pages n print chars linked low high".split())

    parts = rows.mapInPandas(run, "host string, layout long, key long, folded boolean, up long, depth int, fine boolean, kind int, pages long, n long, print long, chars long, linked long, low long, high long")
    return parts.groupBy("host", "layout", "key", "folded").agg(
        *(F.min(c).alias(c) for c in ("up", "depth", "fine", "kind")), *(F.sum(c).alias(c) for c in ("pages", "n", "print", "chars", "linked")), F.min("low").alias("low"), F.max("high").alias("high"))


ROW = "key folded up depth fine kind pages n print chars linked low high".split()


def deduce(rows: list[tuple]) -> tuple[int | None, list[int]]:
    """(container, fixed paths) of one layout from its rows, whose columns are ROW."""
    total = next((r[6] for r in rows if r[0] == 0), 0)
    rows = [r for r in rows if r[0]]
    if total < LEAST:
        return None, []
    by = {r[0]: r for r in rows if not r[1]}
    template, _ = nested([(r[0], r[2], r[3], r[4], r[6], r[7], r[8]) for r in by.values()], max(LEAST, SUPPORT * total), total)

    def slot(r) -> int:
        """The innermost template token around a row's text."""
        around = r[0] if r[1] or r[5] else r[2]
        while around and around not in template:
            around = by[around][2] if around in by else 0
        return around

    slots: dict[int, int] = {}
    for r in rows:
        if r[4] and r[9] > r[10] and r[11] != r[12] and (around := slot(r)):
            slots[around] = slots.get(around, 0) + r[9] - r[10]
    if not slots:
        return None, []
    best = max(slots, key=lambda k: (slots[k], k))

    def whole(key: int) -> int:
        """The article or main around a token, or 0."""
        while key and not (key in by and by[key][5] == 2):
            key = by[key][2] if key in by else 0
        return key

    best = whole(best) or best
    if by[best][5] != 1:  # an element of the article's own
        return best, []

    def inside(key: int) -> bool:
        while key and key != best:
            key = by[key][2] if key in by else 0
        return key == best

    fixed = [r[0] for r in by.values() if r[0] != best and r[6] >= SUPPORT * total and r[9] > 0 and r[11] == r[12] and r[6] > 1]  # the same text on all pages
    return best, [k for k in fixed if inside(k) and slot(by[k]) != best and not whole(k)]


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): one row per host, with [layout, container, fixed paths] of each layout as JSON."""
    rows = _different(_paged(pages))
    known = cut(layouts(rows))
    found = tokens(_with(rows, known, _bytes(known, "host", "layouts", "kept")))

    def run(key, rows):
        best, fixed = deduce(list(rows[ROW].itertuples(index=False, name=None)))
        return pd.DataFrame([(*key, best, fixed)], columns=["host", "layout", "container", "fixed"]).astype({"container": "Int64"})

    each = found.groupBy("host", "layout").applyInPandas(run, "host string, layout long, container long, fixed array<bigint>")

    def joined(key, rows):
        order = {p: i for i, p in enumerate(rows["layouts"].iloc[0])}
        made = [(int(p), int(c) if isinstance(c, str) else None, [int(x) for x in b]) for p, c, b in zip(rows["layout"], rows["container"], rows["fixed"])]
        return pd.DataFrame([(key[0], json.dumps(sorted(made, key=lambda m: order.get(m[0], len(order)) if m[0] else len(order))))], columns=["host", "template"])

    made = each.withColumn("container", F.col("container").cast("string"))  # longs with nulls would turn to doubles
    return made.join(known.select("host", "layouts"), "host").groupBy("host").applyInPandas(joined, "host string, template string")


@lru_cache(maxsize=256)
def _template(text: str) -> dict[int, tuple]:
    return {p: (container, frozenset(fixed)) for p, container, fixed in json.loads(text)}


def page_text(page: str, template: str | None) -> str:
    """The main text by the template of the page's layout."""
    events = list(walk(page))
    known = _template(template) if template else {}
    container, fixed = known.get(layout_of({node.key for node, opens, _ in events if opens}, [p for p in known if p]), (None, ()))
    return _blocks(events, container, fixed)


def _densest(events: list) -> int | None:
    """The container by the elements' meanings: the longest article or main, else the block with the most text in it."""
    size: dict[int, int] = {}
    for node, opens, text in events:
        if opens or node.out:
            continue
        own = node.article
        if own is None:
            own = node.block
            if own.tag in HEADINGS and own.up:
                own = own.up
        size[own.key] = size.get(own.key, 0) + len(text.strip()) * (1000 if node.article else 1)
    best = max(size, key=size.get, default=None)
    return best if best is not None and size[best] else None


def _blocks(events: list, container: int | None, fixed) -> str:
    """The article's blocks, one for each line."""
    if container is not None and not any(opens and node.key == container for node, opens, _ in events):
        container = None  # another layout than the host's
    if container is None:
        container = _densest(events)
    out: list[str] = []
    run: list[str] = []
    edge = None
    state = {ROOT: int(container == ROOT.key)}  # of nodes; 0: outside of the container, 1: inside, 2: inside and left out

    def close():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    for node, opens, text in events:
        if opens:
            around = state[node.up]
            state[node] = 2 if around == 2 or around == 1 and node.bad else 1 if around == 1 or node.key == container else 0
            if around == 0 and state[node] == 0:
                close()
                edge = None
            elif node.tag == "br":
                run.append(" ")
            elif node.tag not in INLINE:
                close()
                edge = node
            continue
        if state[node] == 0:
            close()
            edge = None
            continue
        if state[node] == 2 or node.block.key in fixed:
            continue
        if node.block is not edge:
            close()
            edge = node.block
        run.append(text)
    close()
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): one row per page."""
    text_batches(pages.sparkSession)
    found = cut(templates(pages))
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url").alias("row"), F.col("html").cast("string").alias("html"), host_path(F.col("url"))[0].alias("host"))

    @F.pandas_udf("string")
    def text(page: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([page_text(p or "", t if isinstance(t, str) else None) for p, t in zip(page, template)], dtype=object)

    return _with(rows, found, _bytes(found, "host", "template")).select("page_id", "url", text("html", "template").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
