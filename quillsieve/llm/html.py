"""HTML extraction by union-free regular-expression inference.

Pages of a host share a template. A wrapper is inferred from all of them: a
page's token stream, nested by its tags, is a hypothesis, and hypotheses are
aligned with each other. Where they differ, a mismatch of texts becomes a text
slot, an element that only one has becomes optional, and elements that follow
each other again and again (alone, or in groups of two or three) become a
repeated group; so do all elements of one name where an element has more than
`WIDE` different children. The wrapper is a regular expression without unions
over tags and slots. Each task aligns the pages that it reads, and the partial
wrappers are merged in a tree of groups of about `FAN`, so a host with a third of
all pages is a burden to none.

The wrapper counts, for each of its elements, the pages that have it, its text,
how much of that lies in links, and how much varies from page to page. From
these it tells which elements hold the main text. Scripts, styles and the like
never do. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are struck out by tag or name, unless most of the host's varying text
lies in them: then the name misleads. So are texts that pages share outside the
article (`SHARED` of them have the element, all with the same text), and elements
that are mostly links. What remains is the article, or,
where no element is marked as one, the rest of the body. Every page of the host
is matched with the wrapper element by element and its main text is read off.

Edge cases: a null or empty html gives an empty text; a null url belongs to the
host of all pages without one; a host with one or two different pages has no
shared texts; rows that repeat a page are extracted each, and count as one page
where texts are compared; very long pages are parsed and extracted whole,
elements nested deeper than `DEPTH` as parts of the one at that depth; broken
markup is repaired as browsers do (implied ends, unclosed elements, stray end
tags); an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import cut_lineage, with_values
from quillsieve.llm.urls import with_host_and_path

WIDE = 64  # children of an element of a wrapper
DEPTH = 200  # of a wrapper
FAN = 16  # partial wrappers that are merged at once
HOSTS = 500  # that a task holds at once
DISTINCT = 3  # pages that must differ before a text counts as shared
SHARED = 0.9  # share of the pages that have an element before its text counts as the template's
LARGE = 0.5  # share of the varying text from which on a name misleads
SHOWN = 80  # characters of a text that a wrapper holds; of longer ones a hash
BROADCAST_BYTES = 32 << 20

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div td th table ul ol dl nav aside footer header form blockquote figure".split())

# What is no text, and what is not main text, by element and by words of class, id or role.
NO_TEXT = frozenset("script style noscript template iframe svg button select textarea object canvas dialog head title".split())
JUNK_TAGS = frozenset("nav footer aside form menu".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "contentinfo complementary cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related recommended comment "
    "comments reply replies disqus widget toolbar login search copyright skip pagination pager".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main".split())
HEADER_WORDS = frozenset("header masthead".split())
#: First words of class names that tell of a state, or of what else the page has.
STATES = frozenset("has with without no not is js overflow show hide toggle open".split())
NAMES = JUNK_WORDS | ARTICLE_WORDS | HEADER_WORDS
HIDDEN = "#hidden"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s>/]*)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_LETTERS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/]|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("children", "key", "tag", "words")

    def __init__(self, tag: str, words: frozenset, key: str) -> None:
        self.tag, self.words, self.key = tag, words, key
        self.children: list = []  # nodes and texts


def _tag_end(page: str, at: int, last: dict[str, int], dead: set[int]) -> int:
    """Where the tag whose attributes begin at `at` ends: after the first > outside quotes, or, if a quote is not closed, after the first >.

    last: the page's last place of either quote, so that one that is not closed is known without a search;
    dead: places of quotes from which no end was found, so that none is passed twice.
    """
    k, seen = at, []
    while True:
        k = _PLAIN.match(page, k).end()
        if k == len(page):
            break
        if page[k] == ">":
            return k + 1
        seen.append(k)
        if last[page[k]] <= k or k in dead:
            break
        k = page.find(page[k], k + 1) + 1
    dead.update(seen)
    end = page.find(">", at)
    return end + 1 if end >= 0 else len(page)


def _words(attributes: str) -> frozenset:
    """What class, id and role say of an element: the words of its classes, and of the others those that mean something here."""
    found = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            found.add(HIDDEN)
        elif name in ("class", "id", "role"):
            for token in (a or b or c).lower().split():
                words = _LETTERS.findall(token)
                if words and words[0] not in STATES:
                    found.update(words if name == "class" else NAMES.intersection(words))
    return frozenset(found)


def parse(page: str) -> Node:
    """The page's elements, nested; texts are not decoded."""
    root = Node("#root", frozenset(), "#root")
    stack, at = [root], 0
    opened: Counter = Counter()
    last, dead = {q: page.rfind(q) for q in "\"'"}, set()

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            stack[-1].children.append(m["text"])
        elif kind == "end":
            tag = m["end"].lower()
            if not opened[tag]:
                continue
            bounded = tag in INLINE or tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if bounded and stack[k].tag in SCOPE:
                    break
        elif m["tag"]:
            at = _tag_end(page, m.end(), last, dead)
            tag, rest = m["tag"].lower(), page[m.end() : at]
            words = _words(rest) if "=" in rest or "hidden" in rest.lower() else frozenset()
            if tag not in INLINE and tag != "br" and opened["p"]:  # a block ends a paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k].tag in SCOPE - {"td", "th"}:
                    break
            node = Node(tag, words, f"{tag}.{'.'.join(sorted(words))}" if words else tag)
            stack[-1].children.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                node.children.append(page[at : end.start() if end else len(page)])
                at = end.start() if end else len(page)
                closing = _TOKEN.match(page, at) if end else None
                at = closing.end() if closing else at
            elif tag not in VOID:
                stack.append(node)
                opened[tag] += 1
    return root


# A wrapper's element: [key, flags, slot, children, texts, linked, pages, whole]
# flags: "?" optional, "+" repeated; slot: the text that all pages share, None if
# they differ; texts and linked: lengths of the texts seen below, and of those in links;
# pages: how many pages have the element (of a repeated one, at least how many);
# whole: a hash of all text below, None if pages differ.
KEY, FLAGS, SLOT, CHILDREN, TEXTS, LINKED, PAGES, WHOLE = range(8)


def _flags(*sets: str) -> str:
    return "".join(sorted(set("".join(sets))))


def _fold(children: list[list]) -> list[list]:
    """Repeats of one, two or three elements in a row, as repeated groups."""
    for period in (1, 2, 3):
        out: list[list] = []
        for c in children:
            out.append(c)
            while len(out) >= 2 * period and [x[KEY] for x in out[-period:]] == [x[KEY] for x in out[-2 * period : -period]] and (period == 1 or len({x[KEY] for x in out[-period:]}) > 1):
                again = out[-period:]
                del out[-period:]
                for k in range(period):
                    merged = align(out[k - period], again[k], max)
                    merged[FLAGS] = _flags(merged[FLAGS], "+")
                    out[k - period] = merged
        children = out
    return children


def _slot(text: str) -> str:
    """A text as a wrapper holds it."""
    return text if len(text) <= SHOWN else f"{len(text)}:{xxhash.xxh64_hexdigest(text.encode('utf-8', 'replace'))}"


def _own_text(node: Node) -> str:
    text = "".join([c for c in node.children if isinstance(c, str)])
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def _length_below(node: Node, linked: bool) -> tuple[int, int]:
    """Lengths of all texts below an element, and of those in links."""
    texts, links, todo = 0, 0, [(node, linked)]
    while todo:
        x, inside = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                n = len(c.strip())
                texts += n
                links += n * inside
            else:
                todo.append((c, inside or c.tag == "a"))
    return texts, links


def hypothesis(node: Node, linked: bool = False, depth: int = 0) -> list:
    """A wrapper of one page."""
    if node.tag in NO_TEXT:
        return [node.key, "", "", [], 0, 0, 1, 0]
    linked = linked or node.tag == "a"
    if depth == DEPTH:
        texts, links = _length_below(node, linked)
        return [node.key, "", None if texts else "", [], texts, links, 1, None]
    slot = _own_text(node)
    children = [hypothesis(c, linked, depth + 1) for c in node.children if not isinstance(c, str)]
    texts, links = len(slot) + sum(c[TEXTS] for c in children), len(slot) * linked + sum(c[LINKED] for c in children)
    whole = None if any(c[WHOLE] is None for c in children) else xxhash.xxh64_intdigest("\0".join([slot, *(str(c[WHOLE]) for c in children)]).encode("utf-8", "replace"))
    return [node.key, "", _slot(slot), _narrow(_fold(children)), texts, links, 1, whole]


def matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of places, ascending, at which two key sequences are aligned: a longest common subsequence."""
    head = next((k for k, (i, j) in enumerate(zip(x, y, strict=False)) if i != j), min(len(x), len(y)))
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    u, v = x[head : len(x) - tail], y[head : len(y) - tail]
    best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
    for i in range(len(u) - 1, -1, -1):
        for j in range(len(v) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if u[i] == v[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [(k, k) for k in range(head)], 0, 0
    while i < len(u) and j < len(v):
        if u[i] == v[j]:
            found.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def _narrow(children: list[list]) -> list[list]:
    """Children of which there are more than WIDE: those of one key, or else of one tag, as one repeated group."""
    for name in (lambda key: key, lambda key: key.split(".")[0]):
        if len(children) <= WIDE:
            break
        groups: dict[str, list] = {}
        for c in children:
            key = name(c[KEY])
            c = [key, _flags(c[FLAGS], "+?"), *c[SLOT:]]
            groups[key] = align(groups[key], c, max) if key in groups else c
        children = list(groups.values())
    return children


def _sum(a: int, b: int) -> int:
    return a + b


def align(a: list, b: list, pages=_sum) -> list:
    """The wrapper of both wrappers of an element; pages: of their numbers of pages, max where they may be the same pages."""
    x, y = a[CHILDREN], b[CHILDREN]
    out, i, j = [], 0, 0
    for to_i, to_j in [*matches([c[KEY] for c in x], [c[KEY] for c in y]), (len(x), len(y))]:
        out += [[c[KEY], _flags(c[FLAGS], "?"), *c[SLOT:]] for c in x[i:to_i] + y[j:to_j]]
        if to_i < len(x):
            out.append(align(x[to_i], y[to_j], pages))
        i, j = to_i + 1, to_j + 1
    return [a[KEY], _flags(a[FLAGS], b[FLAGS]), a[SLOT] if a[SLOT] == b[SLOT] else None, _narrow(_fold(out)), a[TEXTS] + b[TEXTS], a[LINKED] + b[LINKED], pages(a[PAGES], b[PAGES]), a[WHOLE] if a[WHOLE] == b[WHOLE] else None]


def as_expression(w: list) -> str:
    """The wrapper written as a regular expression over tags; # is a text slot."""
    inside = ("#" if w[SLOT] is None else json.dumps(w[SLOT]) if w[SLOT] else "") + " ".join(map(as_expression, w[CHILDREN]))
    return f"<{w[KEY]}>({inside})" + w[FLAGS].replace("+?", "*")


def _named_junk(tag: str, words: frozenset, inside: bool) -> bool:
    """Whether an element's tag or names say that it is struck out; a header counts only outside the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in JUNK_TAGS or HIDDEN in words:
        return True
    if words & ARTICLE_WORDS and not words & {"comment", "comments", "ad", "ads", "related", "sidebar"}:
        return False
    return bool(words & JUNK_WORDS) or not inside and (tag == "header" or bool(words & HEADER_WORDS))


def _named_article(tag: str, words: frozenset) -> bool:
    return tag in ("article", "main") or tag in ("div", "section") and bool(words & ARTICLE_WORDS) and not words & JUNK_WORDS


def _name(key: str) -> tuple[str, frozenset]:
    tag, *words = key.split(".")
    return tag, frozenset(words)


def compile_wrapper(w: list, distinct: int) -> list:
    """The wrapper as [key, repeated, role, shared text, children]; role: "d" struck out, "a" article, "" neither. distinct: how many different pages it is of."""
    varying: dict[int, int] = {}
    everywhere = lambda x: distinct >= DISTINCT and x[PAGES] >= SHARED * w[PAGES] and "+" not in x[FLAGS]

    def weigh(x: list, linked: bool) -> int:
        """Text below an element that is in no link and, of three pages or more, not the same on all of them."""
        tag = _name(x[KEY])[0]
        linked = linked or tag == "a"
        own = x[TEXTS] - sum(c[TEXTS] for c in x[CHILDREN])
        counts = not linked and not (everywhere(x) and x[SLOT] is not None)
        below = [weigh(c, linked) for c in x[CHILDREN]]
        varying[id(x)] = 0 if tag in NO_TEXT or everywhere(x) and x[WHOLE] is not None else own * counts + sum(below)
        return varying[id(x)]

    total = weigh(w, False)

    def build(x: list, inside: bool, again: bool = False) -> list:
        tag, words = _name(x[KEY])
        role, again = "", again or "+" in x[FLAGS]
        share = varying[id(x)] / total if total else 1.0
        common = total > 0 and everywhere(x) and not again and not inside
        if tag in NO_TEXT or HIDDEN in words or _named_junk(tag, words, inside) and share <= LARGE:
            role = "d"
        elif not inside and _named_article(tag, words) and x[TEXTS] > x[LINKED] * 2 and (tag in ("article", "main") or share > LARGE):
            role = "a"
        elif common and x[WHOLE] is not None and x[TEXTS]:
            role = "d"
        elif not inside and x[TEXTS] > 0 and x[LINKED] > 0.5 * x[TEXTS] and tag in ("div", "ul", "ol", "section", "table", "p"):
            role = "d"
        shared = x[SLOT] if common and x[SLOT] and role != "a" else None
        return [x[KEY], int("+" in x[FLAGS]), role, shared, [build(c, inside or role == "a", again) for c in x[CHILDREN]] if role != "d" else []]

    return build(w, False)


def infer(pages: list[str]) -> list:
    """The compiled wrapper of some pages of a host."""
    wrapper = None
    for page in pages:
        h = hypothesis(parse(page))
        wrapper = h if wrapper is None else align(wrapper, h)
    return compile_wrapper(wrapper, len(set(pages)))


class Opened:
    """A compiled wrapper's element, with the places of its children by key."""

    __slots__ = ("children", "places", "repeated", "role", "shared")

    def __init__(self, compiled: list) -> None:
        _, self.repeated, self.role, self.shared, children = compiled
        self.children = [Opened(c) for c in children]
        self.places: dict[str, list[int]] = {}
        for k, c in enumerate(children):
            self.places.setdefault(c[0], []).append(k)

    def child(self, node: Node, k: int) -> tuple[Opened | None, int]:
        """The element for a child of the page: the next one of its name, else an earlier one; and where to go on."""
        at = self.places.get(node.key) or self.places.get(node.tag)
        if not at:
            return None, k
        i = bisect.bisect_left(at, k)
        if i == len(at):
            return self.children[at[0]], k
        return self.children[at[i]], at[i] if self.children[at[i]].repeated else at[i] + 1


def extract(page: str | None, wrapper: Opened | list | None = None) -> str:
    """The page's main text; without a wrapper, by that of the page alone."""
    if not page:
        return ""
    root = parse(page)
    if wrapper is None:
        wrapper = compile_wrapper(hypothesis(root), 1)
    if not isinstance(wrapper, Opened):
        wrapper = Opened(wrapper)
    in_article: list[str] = []
    in_body: list[str] = []
    found = False
    todo: list = [(root, wrapper, False)]  # texts, and nodes with their elements of the wrapper; each with whether it is inside the article
    while todo:
        node, known, inside = todo.pop()
        if isinstance(node, str):
            in_body.append(node)
            if inside:
                in_article.append(node)
            continue
        role = known.role if known else "d" if node.tag in NO_TEXT or _named_junk(node.tag, node.words, inside) else "a" if not inside and _named_article(node.tag, node.words) else ""
        if role == "d":
            if node.tag not in INLINE:
                todo.append((" ", None, True))
            continue
        if role == "a":
            inside = found = True
        drop = known is not None and known.shared and _slot(_own_text(node)) == known.shared
        parts, k = [], 0
        for c in node.children:
            if isinstance(c, str):
                parts.append((" " if drop else entities.unescape(c) if "&" in c else c, None, inside))
                continue
            element, k = known.child(c, k) if known else (None, k)
            parts.append((c, element, inside))
        if node.tag not in INLINE:
            edge = (" ", None, True)
            parts = [edge, *parts, edge]
        todo += reversed(parts)
    return " ".join("".join(in_article if found else in_body).split())


def _packed(wrapper: list) -> bytes:
    return zlib.compress(json.dumps(wrapper, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def _unpacked(data: bytes) -> list:
    return json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))


_PARTIAL = "host string, wrapper binary, seen array<long>"


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) as partial wrappers with the least hashes of their pages."""
    held: dict[str, tuple[list | None, set]] = {}

    def flush() -> pa.RecordBatch:
        hosts = list(held)
        columns = [pa.array(hosts, pa.string()), pa.array([_packed(held[h][0]) for h in hosts], pa.binary()), pa.array([sorted(held[h][1])[:DISTINCT] for h in hosts], pa.list_(pa.int64()))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "seen"])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own, seen = held.get(host, (None, set()))
            mark = xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) - (1 << 63)
            h = hypothesis(parse(page))
            held[host] = (h if own is None else align(own, h), seen if mark in seen else set(sorted([*seen, mark])[:DISTINCT]))
            if len(held) >= HOSTS:
                yield flush()
    if held:
        yield flush()


def _merge(table: pa.Table) -> tuple[list, list[int]]:
    rows = sorted(zip(table["wrapper"].to_pylist(), table["seen"].to_pylist(), strict=True))
    wrapper = None
    for data, _ in rows:
        own = _unpacked(data)
        wrapper = own if wrapper is None else align(wrapper, own)
    return wrapper, sorted({x for _, seen in rows for x in seen})[:DISTINCT]


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (compiled, packed) and pages (how many it has) of each host of pages(url, html)."""
    hosted = with_host_and_path(pages.select("url", "html")).select("host", "html")
    level = cut_lineage(hosted.where("html <> ''").mapInArrow(_partials, _PARTIAL))
    most = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0

    def merge(table: pa.Table) -> pa.Table:
        wrapper, seen = _merge(table)
        return pa.table({"host": [table["host"][0].as_py()], "wrapper": pa.array([_packed(wrapper)], pa.binary()), "seen": pa.array([seen], pa.list_(pa.int64()))})

    def finish(table: pa.Table) -> pa.Table:
        wrapper, seen = _merge(table)
        return pa.table({"host": [table["host"][0].as_py()], "wrapper": pa.array([_packed(compile_wrapper(wrapper, len(seen)))], pa.binary())})

    while most > FAN:
        parts = -(-most // FAN)
        dealt = level.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        level = cut_lineage(dealt.groupBy("host", "part").applyInArrow(merge, _PARTIAL))
        most = parts
    learned = level.groupBy("host").applyInArrow(finish, "host string, wrapper binary")
    return learned.join(hosted.groupBy("host").agg(F.count("*").alias("pages")), "host")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page of pages(page_id, url, html)."""
    learned = cut_lineage(wrappers(pages))
    size = learned.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = with_host_and_path(pages.select("page_id", "url", "html")).drop("path")
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = None
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in learned.select("host", "wrapper").toLocalIterator()})
        rows = rows.select("page_id", "url", "html", "host")
    else:
        without = rows.join(learned.select("host"), "host", "left_anti").select("page_id", "url", "html", F.lit(None).cast("binary").alias("wrapper"))
        rows = with_values(rows, "host", learned, "pages").select("page_id", "url", "html", "wrapper").unionByName(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            texts = []
            for page, key in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key not in opened:
                    data = key if shared is None else shared.value.get(key)
                    if len(opened) >= HOSTS:
                        opened.clear()
                    opened[key] = Opened(_unpacked(data)) if data else None
                texts.append(extract(page, opened[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
