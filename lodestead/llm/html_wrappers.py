"""Main text of web pages by wrappers inferred per host.

The pages of a host come from a few templates. A page is a stream of tokens: start tags with the words of their class and
id, texts, end tags. A wrapper is a union-free regular expression over such streams. It starts as one page and is aligned
with one page after another. Texts that are equal so far are template, and become slots ``#`` once they differ. Where tags
or what they hold differ, elements that are template as a whole meet first; between them the next tag that fits is searched
on both sides: what the shorter way skips is a repetition ``( )+`` if it squares with its neighbours, and optional ``( )?``
if not. Nothing is folded without a mismatch.

Alignment depends on order, so the order is that of the data: distinct streams of a host are dealt to buckets by their
hash, aligned in order of hash, and the buckets' wrappers are aligned in rounds of ``FAN``. No task reads a large host,
and neither the layout of the input nor repeated rows change a wrapper.

Boilerplate is what the template holds: texts in one place with the same content on ``PAGES`` different pages and half of
the host's, and lists that are nothing but links on such pages. Inside ``article`` and ``main`` only elements with doubtful
names are judged so. Elements that their name, class or role as a whole declares to be menus, adverts, forms, comments and
the like go without a vote, as their text may differ from page to page. All other text is the article, in page order.
Several ``article`` in a row are teasers, and go, unless most of the page's text is theirs.

Defined results: a null html, or one without such text, has the empty text and 0 characters; a null url belongs to the
host without a name; rows that repeat are extracted one by one; broken markup (missing or stray end tags, cut pages) is
read as far as it goes, to any depth; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Element names and the words in class, id and role attributes that tell what an element is for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr mi mn mo mrow ms msub msup mtext semantics".split())
RAW = set("script style template noscript iframe svg canvas object textarea title".split())
ASIDE = set("nav footer aside form button select option menu dialog head".split())
ASIDE_WORDS = set("nav navbar navigation menu menus sidebar sidebars aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice notices alert newsletter subscribe subscription share sharing social comment comments commentlist discussion disqus respond reply replies related recommended breadcrumb breadcrumbs pager pagination footer popup modal overlay widget toolbar login signup search skip masthead complementary contentinfo".split())
#: Words that leave the meaning of a compound with one of those as it is; elements whose class and id say nothing; headings.
NEUTRAL = set("bar block box buttons links x".split())
FRAMES = set("html body main article".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = set("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[0-9]+")

#: So many different pages, and half of the host's, must agree before something counts as the host's template.
PAGES = 3
TEXT = "#@*"
#: Streams of a bucket, about, and wrappers that are aligned at once.
FAN = 64
SALTS = 32


class Element:
    __slots__ = ("aside", "children", "doubtful", "inline", "kind", "name")

    def __init__(self, name: str, kind: str, aside: bool, doubtful: bool = False, inline: bool = False):
        self.name, self.kind, self.aside, self.doubtful, self.inline, self.children = name, kind, aside, doubtful, inline, []


class Linked(str):
    """Text inside a link, with where the link begins."""

    link: int


def element(name: str, attributes: str) -> Element:
    """An element whose kind is its name with the words of its class, id and role.

    It stands aside by a whole class, id or role, or by a compound of such words only (``cookie-banner``). One such word
    among others (``share-price``) is a doubtful case, and so is the id of a section; the host's pages decide on it.
    """
    words: list[str] = []
    aside, doubtful = name in ASIDE, False
    if attributes:
        for found in ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key in ("class", "id", "role", "itemprop"):
                for token in value.lower().split():
                    parts = [p for p in WORD.findall(token) if not p.isdigit()]
                    words += parts
                    if ASIDE_WORDS.isdisjoint(parts) or name in FRAMES and (key != "role" or name != "article") or name in HEADINGS and key == "id":
                        continue
                    if all(p in ASIDE_WORDS or p in NEUTRAL for p in parts) and not (name == "section" and key == "id"):
                        aside = True
                    else:
                        doubtful = name not in HEADINGS
            elif (key == "hidden" or key == "aria-hidden" and value == "true") and name not in ("html", "body"):
                aside = True
    return Element(name, ".".join([name, *sorted(set(words))]), aside, doubtful and not aside)


def parsed(html: str) -> Element:
    """The tree of block elements; inline elements are part of the text."""
    root = Element("", "", False)
    stack, at, link, began = [root], 0, 0, 0
    opened: Counter[str] = Counter()

    def said(text: str) -> None:
        if link:
            text = Linked(text)
            text.link = began
        stack[-1].children.append(text)

    def close(depth: int) -> None:
        nonlocal link
        for gone in stack[depth:]:
            opened[gone.name] -= 1
        del stack[depth:]
        if link > depth:
            link = 0

    while (found := TOKEN.search(html, at)) is not None:
        if found.start() > at:
            said(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            if found[0] == "<":
                stack[-1].children.append("<")
            continue
        name = name.lower()
        if found[1]:
            if name == "a":
                link = 0
            if name in VOID or name in INLINE and stack[-1].name != name or not opened[name]:
                continue
            depth = len(stack) - 1
            while stack[depth].name != name:
                depth -= 1
            close(depth)
            continue
        if name in RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in VOID:
            stack[-1].children.append(" ")
            continue
        if name in INLINE:
            # An inline element that is marked as an advert or the like stands apart; all others are text.
            if name == "a":
                link, began = len(stack) if "href" in found[3].lower() else 0, at
            if found[3] and not found[3].endswith("/") and (inline := element(name, found[3])).aside:
                inline.inline = True
                stack[-1].children.append(inline)
                stack.append(inline)
                opened[name] += 1
            continue
        if stack[-1].name == "p" and name in CLOSES_P or stack[-1].name == name and name in CLOSED_BY_SAME:
            close(len(stack) - 1)
        block = element(name, found[3])
        stack[-1].children.append(block)
        stack.append(block)
        opened[name] += 1
    if at < len(html):
        said(html[at:])
    headers(root)
    return root


def headers(root: Element) -> None:
    """A header outside the article is the site's, unless it alone has a heading."""
    outer: list[tuple[Element, bool]] = []
    titled = False
    walk = [(root, False, None)]
    while walk:
        node, inside, header = walk.pop()
        if node.name == "header" and not inside and header is None:
            header = len(outer)
            outer.append((node, False))
        if node.name in HEADINGS:
            titled |= inside
            if header is not None:
                outer[header] = (outer[header][0], True)
        inside = inside or node.name in ("article", "main")
        walk += [(x, inside, header) for x in node.children if isinstance(x, Element) and not x.aside]
    for node, heading in outer:
        node.aside = titled or not heading


def items(node: Element) -> list:
    """The elements and texts, as (text, 0 or how many links are all of it), that do not stand aside; references are decoded."""
    out: list = []
    text: list[str] = []
    links: set[int] | None = set()

    def flush() -> None:
        # White space that character references stand for counts as white space too.
        if joined := " ".join(unescape("".join(text)).split()):
            out.append((joined, len(links or ())))

    for child in node.children:
        if isinstance(child, str):
            text.append(child)
            if links is not None and not child.isspace():
                if isinstance(child, Linked):
                    links.add(child.link)
                else:
                    links = None
        elif not child.inline:
            flush()
            text, links = [], set()
            if not child.aside:
                out.append(child)
    flush()
    return out


def digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "replace"))


def below(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, path)


def stream(root: Element) -> str:
    """A page's tokens: ``<`` or ``?`` (doubtful) and the kind, ``#``, ``@`` (one link) or ``*`` (several) and the text's digest, ``>``."""
    tokens: list[str] = []
    stack = [iter(items(root))]
    while stack:
        for item in stack[-1]:
            if isinstance(item, tuple):
                tokens.append(TEXT[min(item[1], 2)] + digest(item[0]))
            else:
                tokens.append("<?"[item.doubtful] + item.kind)
                stack.append(iter(items(item)))
                break
        else:
            stack.pop()
            if stack and tokens[-1][0] in "<?":
                tokens.pop()  # without text
            elif stack:
                tokens.append(">")
    return "\n".join(tokens)


# -- wrappers ------------------------------------------------------------------------------------------------------------
# A wrapper is its root node: [kind, optional, repeated, pages, digest, children]; kind is the token without a digest.


def page(tokens: str) -> list:
    """A stream as the wrapper of one page."""
    root = ["<", False, False, 1, "", []]
    stack = [root]
    for token in tokens.split("\n") if tokens else ():
        if token == ">":
            stack.pop()
        elif token[0] in TEXT:
            stack[-1][5].append([token[0], False, False, 1, token[1:], []])
        else:
            node = [token, False, False, 1, "", []]
            stack[-1][5].append(node)
            stack.append(node)
    return root


def packed(root: list) -> str:
    out: list[str] = []
    walk: list = [root]
    while walk:
        node = walk.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        out.append(f"{node[0]} {node[1] + 2 * node[2]} {node[3]} {node[4]}")
        walk.append(">")
        walk += reversed(node[5])
    return "\n".join(out)


def unpacked(text: str) -> list:
    top = ["", False, False, 0, "", []]
    stack = [top]
    for line in text.split("\n"):
        if line == ">":
            stack.pop()
            continue
        kind, marks, pages, said = line.split(" ")
        node = [kind, marks in "13", marks in "23", int(pages), said, []]
        stack[-1][5].append(node)
        stack.append(node)
    return top[5][0]


def merged(a: list, b: list, apart: bool = True) -> list:
    """Two nodes of one kind aligned; ``apart``: they come from different pages, else from neighbours in one."""
    return [a[0] if a[0] == b[0] else "#" if "#" in (a[0], b[0]) else "@", a[1] and b[1], a[2] or b[2], a[3] + b[3] if apart else max(a[3], b[3]), a[4] if a[4] == b[4] else "", aligned(a[5], b[5], apart)]


def aligned(a: list[list], b: list[list], apart: bool) -> list[list]:
    """Two streams up to the end tag of the element around them, tag by tag and text by text."""
    left, right = [shape(x) for x in a], [shape(x) for x in b]
    if len(a) == len(b) and all([alike(left[k], right[k]) for k in range(len(a))]):
        return [merged(a[k], b[k], apart) for k in range(len(a))]
    out, i, j = [], 0, 0
    for k, m in [*anchors(a, b), (len(a), len(b))]:
        out += between(a[i:k], b[j:m], left[i:k], right[j:m], apart)
        if k < len(a):
            out.append(merged(a[k], b[m], apart))
        i, j = k + 1, m + 1
    for width in (1, 2, 3, 4):
        out = squared(out, width)
    return out


def shape(node: list) -> tuple[str, frozenset[str]]:
    """The kind of a node and those of what it always has."""
    return plain(node[0]), frozenset([plain(x[0]) for x in node[5] if not x[1]])


def plain(kind: str) -> str:
    return "#" if kind in TEXT else kind


def alike(a: tuple[str, frozenset[str]], b: tuple[str, frozenset[str]]) -> bool:
    return a == b or a[0] == b[0] and 2 * len(a[1] & b[1]) > len(a[1] | b[1])


def anchors(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of elements that are template as a whole, once on each side and in the same order on both."""
    here, there = places([content(x) for x in a]), places([content(x) for x in b])
    pairs = [(found[0], there[x][0]) for x, found in here.items() if x and len(found) == 1 and len(there.get(x, ())) == 1]
    # The longest chain whose places rise on both sides.
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k in range(len(pairs)):
        at = bisect_left(tails, pairs[k][1])
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [pairs[k][1]], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def content(node: list) -> int:
    """Hash of a node whose texts are all template, with nothing optional or repeated inside; else 0."""
    found, walk = 1, [node]
    while walk:
        x = walk.pop()
        if x is not node and x[1] or x[2] or x[0] in TEXT and not x[4]:
            return 0
        found = below(found, x[0] + x[4])
        walk += x[5]
    return found


def between(a: list[list], b: list[list], left: list, right: list, apart: bool) -> list[list]:
    """Where tags differ, the next one that fits is searched on both sides, and the shorter way is taken."""
    here, there = places(left), places(right)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if alike(left[i], right[j]):
            out.append(merged(a[i], b[j], apart))
            i, j = i + 1, j + 1
            continue
        skip_b, skip_a = following(there, left[i], j), following(here, right[j], i)
        if skip_a is None and skip_b is None:
            out += [maybe(a[i]), maybe(b[j])]
            i, j = i + 1, j + 1
        elif skip_a is None or skip_b is not None and skip_b - j <= skip_a - i:
            out += [maybe(x) for x in b[j:skip_b]]
            j = skip_b
        else:
            out += [maybe(x) for x in a[i:skip_a]]
            i = skip_a
    return out + [maybe(x) for x in [*a[i:], *b[j:]]]


def places(kinds: list) -> dict:
    out: dict = {}
    for k, kind in enumerate(kinds):
        out.setdefault(kind, []).append(k)
    return out


def following(where: dict, kind: tuple[str, frozenset[str]], at: int) -> int | None:
    """The first place from ``at`` on of something alike."""
    best = None
    for other, found in where.items():
        if alike(kind, other) and (k := bisect_left(found, at)) < len(found) and (best is None or found[k] < best):
            best = found[k]
    return best


def maybe(node: list) -> list:
    return [node[0], True, *node[2:]]


def squared(nodes: list[list], width: int) -> list[list]:
    """Neighbouring groups of ``width`` that are alike are one repeated group, where a mismatch has shown them to vary."""
    out: list[list] = []
    for node in nodes:
        out.append(node)
        while len(out) >= 2 * width:
            first, second = out[-2 * width : -width], out[-width:]
            if not any([x[1] or x[2] for x in [*first, *second]]) or not all([repeats(first[k], second[k]) for k in range(width)]):
                break
            both = [merged(first[k], second[k], False) for k in range(width)]
            for x in both:
                x[2] = True
            out[-2 * width :] = both
    return out


def repeats(a: list, b: list) -> bool:
    """Whether two neighbours are the same but for slots; contents that differ and are template so far stay apart."""
    if not alike(shape(a), shape(b)):
        return False
    x, y = content(a), content(b)
    return not x or not y or x == y


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression; template texts show as ``=``."""
    inner = ("=" if node[4] else "#") if node[0] in TEXT else "".join([expression(x) for x in node[5]])
    if node[0][1:]:
        inner = f"<{node[0][1:]}>{inner}</{node[0][1:].split('.')[0]}>"
    mark = "+" * node[2] + "?" * node[1]
    return f"({inner}){mark}" if mark else inner


def template(root: list) -> tuple[list[int], list[int]]:
    """(keys of template texts, paths of lists of links), as hashes of the kinds on the way to them."""
    texts, lists, slots = [], [], 0
    usual = lambda node: node[3] >= PAGES and 2 * node[3] >= root[3]
    links = link_counts(root)
    walk = [(root, 0, True)]
    while walk:
        node, path, open_ = walk.pop()
        for child in node[5]:
            if child[0] in TEXT:
                if open_ and child[4] and usual(child):
                    texts.append(below(path, child[4]))
                elif child[0] == "#":
                    slots += 1
                continue
            open_below = child[0][0] == "?" or open_ and child[0][1:].split(".")[0] not in ("article", "main")
            at = below(path, child[0][1:])
            if open_below and links[id(child)] > 1 and usual(child):
                lists.append(at)
            walk.append((child, at, open_below))
    found = [np.array(sorted(set(x)), np.uint64).view(np.int64).tolist() for x in (texts, lists)]
    return tuple(found) if slots else ([], [])


def link_counts(root: list) -> dict[int, float]:
    """How many links each node holds, a repeated one counting twice; below nothing where there is other text."""
    order = [root]
    for node in order:
        order += node[5]
    counts: dict[int, float] = {}
    for node in reversed(order):
        own = {"#": -np.inf, "@": 1, "*": 2}[node[0]] if node[0] in TEXT else sum([counts[id(x)] for x in node[5]])
        counts[id(node)] = own * (1 + node[2])
    return counts


# -- extraction ----------------------------------------------------------------------------------------------------------


def only_links(node: Element) -> bool:
    walk = [node]
    while walk:
        for item in items(walk.pop()):
            if isinstance(item, Element):
                walk.append(item)
            elif not item[1]:
                return False
    return True


def extract(html: str | None, texts: set[int] = frozenset(), lists: set[int] = frozenset()) -> str:
    """All text that neither stands aside nor is the host's template, in page order."""
    out: list[tuple[str, bool]] = []
    stack = [(iter(items(parsed(html or ""))), 0, False, ())]
    while stack:
        walk, path, teaser, rows = stack[-1]
        for item in walk:
            if isinstance(item, tuple):
                if not texts or signed(below(path, digest(item[0]))) not in texts:
                    out.append((item[0], teaser))
                continue
            at = below(path, item.kind)
            if lists and signed(at) in lists and only_links(item):
                continue
            inner = items(item)
            stack.append((iter(inner), at, teaser or id(item) in rows, in_a_row(inner)))
            break
        else:
            stack.pop()
    less = sum(len(x) for x, teaser in out if teaser) <= sum(len(x) for x, teaser in out if not teaser)
    return " ".join(x for x, teaser in out if not (teaser and less))


def in_a_row(found: list) -> set[int]:
    """Those ``article`` elements, by identity, that stand next to another one."""
    return {id(z) for x, y in zip(found, found[1:], strict=False) if isinstance(x, Element) and isinstance(y, Element) and x.name == y.name == "article" for z in (x, y)}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# -- passes --------------------------------------------------------------------------------------------------------------

WRAPPER = "host string, bucket long, wrapper string"


def _streams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"host": frame["host"], "stream": [stream(parsed(x or "")) for x in frame["html"]]})


def _unlimited() -> None:
    """Pages nest to any depth; calls between Python functions take no C stack."""
    sys.setrecursionlimit(1 << 30)


def _first(key, rows):
    _unlimited()
    whole = None
    for tokens in sorted(rows["stream"], key=lambda x: (xxhash.xxh3_64_intdigest(x), x)):
        whole = merged(whole, page(tokens)) if whole else page(tokens)
    return pd.DataFrame({"host": [key[0]], "bucket": [key[1]], "wrapper": [packed(whole)]})


def _next(key, rows):
    _unlimited()
    whole = None
    for text in rows.sort_values("bucket")["wrapper"]:
        whole = merged(whole, unpacked(text)) if whole else unpacked(text)
    return pd.DataFrame({"host": [key[0]], "bucket": [key[1]], "wrapper": [packed(whole)]})


def hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: one row per host."""
    streams = hosts(pages).select("host", F.col("html").cast("string").alias("html")).mapInPandas(_streams, "host string, stream string")
    streams = stored(streams.dropDuplicates(["host", "stream"]), "html-streams")
    counts = streams.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("buckets"))
    most = counts.agg(F.max("buckets")).first()[0] or 0
    # Streams meet their host's count in SALTS parts, so that a large host is not one key.
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = streams.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "stream"), F.lit(SALTS).cast("long")))
    dealt = salted.join(counts, ["host", "salt"]).select("host", F.pmod(F.xxhash64("stream"), F.col("buckets")).alias("bucket"), "stream")
    found = dealt.groupBy("host", "bucket").applyInPandas(_first, WRAPPER)
    while most > 1:
        most = -(-most // FAN)
        found = found.withColumn("bucket", F.floor(F.col("bucket") / FAN)).groupBy("host", "bucket").applyInPandas(_next, WRAPPER)
    return found.select("host", "wrapper")


def templates(wrapped: DataFrame) -> DataFrame:
    """host, texts, lists: what ``template`` finds in each wrapper."""

    @F.pandas_udf("texts array<long>, lists array<long>")
    def read(trees: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([template(unpacked(x)) for x in trees], columns=["texts", "lists"])

    return wrapped.select("host", read("wrapper").alias("w")).select("host", "w.*")


def main_text(pages: DataFrame) -> DataFrame:
    # Stored, so that the planner knows its size: it is broadcast only if small, and else joined by a shuffle.
    known = stored(templates(wrappers(pages)), "html-templates")

    @F.pandas_udf("string")
    def main(html: pd.Series, texts: pd.Series, lists: pd.Series) -> pd.Series:
        as_set = lambda x: frozenset() if x is None else frozenset(x.tolist())
        return pd.Series([extract(x, as_set(t), as_set(k)) for x, t, k in zip(html, texts, lists, strict=True)], dtype=object)

    rows = hosts(pages.select("page_id", "url", "html")).join(known, "host", "left")
    found = rows.select("page_id", "url", main(F.col("html").cast("string"), "texts", "lists").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
