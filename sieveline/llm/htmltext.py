"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship

_S = r"\t\n\f\r "
#: Markup by the rules of HTML: quotes count only after an equals sign, a tag or comment that does not end runs to the end of the page.
_ATTRIBUTE = rf"""=?[^{_S}/>=]*+(?:[{_S}]*+=[{_S}]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^{_S}>"'][^{_S}>]*+)?+)?+"""
_TAG = re.compile(rf"<!-->|<!--->|<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|</[^a-zA-Z>][^>]*+>?|</>|<(/?)([a-zA-Z][^{_S}/>]*+)((?:[{_S}/]++|(?=[^{_S}/>]){_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_MARK = re.compile(rf"""([^{_S}/>=]++)(?:[{_S}]*+=[{_S}]*+(?:"([^"]*+)"?|'([^']*+)'?|([^{_S}>"'][^{_S}>]*+))?+)?+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements whose content is not the article.
ASIDE = frozenset("aside button canvas datalist dialog footer head header iframe input menu nav noscript object script select style svg template textarea title video audio".split())
#: Names of class, id and role for what is not the article; a compound name (site-header, reader_comments) counts if all its parts are of these
#: or NEUTRAL, so no-sidebar, has-header or social-history do not. LAYOUT_WORDS say where something stands, ASIDE_WORDS what it is.
LAYOUT_WORDS = frozenset("banner complementary contentinfo footer header modal popup sidebar widget widgets".split())
ASIDE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disclaimer disqus menu nav navbar navigation newsletter notice notices pager pagination promo promos related replies reply share sharing signup social sponsor sponsored subscribe subscription toolbar".split())
NEUTRAL = frozenset("area bar block bottom box button buttons center column consent container feed form global group icons inline inner item items large left links list main mobile outer page panel posts primary reader readers right row secondary section site slot small sticky tertiary thread top unit user wrap wrapper".split())
#: What readers write: names with a part that begins so count whatever the other parts are, unless one of them says only that there are comments.
READERS = re.compile(r"comment(?!ar)|responses?$|respond$|repl(?:y|ies)$|disqus")
ABOUT = frozenset("no not has have with without open opened closed status enabled disabled on off allow allowed".split())
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
KEPT = frozenset(("html", "body"))
#: Elements below so many others are not parents of what follows, as in browsers.
DEPTH = 512
#: Share of a list's text in links, and characters of a link, that make it a menu where it stands before or after all other text.
LINKED, LINK_CHARS = 0.8, 30
#: What an opening element closes before it, up to the element that bounds the search.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "p": ("p", ())}


class Page:
    """A page's elements as parallel lists, parents before children, and its text runs. Time grows with the page's length."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside, self.marked, self.link = ["#root"], [-1], [False], [0], [False]
        self.runs: list[tuple[int, int, str]] = []
        block, stack, at = 0, [0], 0
        self.open: dict[str, int] = {}
        while m := _TAG.search(source, at):
            if m.start() > at:
                self.runs.append((stack[-1], block, source[at : m.start()]))
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if name not in INLINE:
                block += 1
            if m[1]:
                if self.open.get(name):
                    i = len(stack) - 1
                    while self.tag[stack[i]] != name:
                        i -= 1
                    self._pop(stack, i)
                continue
            if name not in INLINE:
                self._close(stack, name)
            if name == "br":
                self.runs.append((stack[-1], block, " "))
            node, up = len(self.tag), stack[-1]
            hidden, marked = self._marks(m[3]) if m[3] and name not in KEPT else (False, 0)
            self.tag.append(name)
            self.parent.append(up)
            self.aside.append(self.aside[up] or name in ASIDE or hidden)
            self.marked.append(marked)
            self.link.append(self.link[up] or name == "a")
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                block += 1
            elif name not in VOID and not (m[3].endswith("/") and not m[3].endswith("=/")) and len(stack) <= DEPTH:
                stack.append(node)
                self.open[name] = self.open.get(name, 0) + 1
        if at < len(source):
            self.runs.append((stack[-1], block, source[at:]))

    def _pop(self, stack: list[int], i: int) -> None:
        for node in stack[i:]:
            self.open[self.tag[node]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], name: str) -> None:
        if self.open.get("p"):  # a block ends the paragraph that is open
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t == "p":
                    self._pop(stack, i)
                    break
                if t not in INLINE:
                    break
        if name in _CLOSES:
            shut, bounds = _CLOSES[name]
            shut = shut.split()
            if not any(self.open.get(t) for t in shut):
                return
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in bounds or t in KEPT or t in ("main", "article"):
                    break
                if t in shut:
                    self._pop(stack, i)
                    if name == "tr" and self.tag[stack[-1]] == "tr":
                        self._pop(stack, len(stack) - 1)
                    break

    @staticmethod
    def _marks(marks: str) -> tuple[bool, int]:
        """Whether attributes hide an element, and whether its names are of what is not the article: 1 by their place, 2 by what it is, else 0."""
        marked = 0
        for name, *values in _MARK.findall(marks):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
                return True, marked
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return True, marked
            elif name in ("class", "id", "role"):
                marked = max([marked, *map(_kind, value.split())])
        return False, marked


def _kind(name: str) -> int:
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    if any(map(READERS.match, parts)) and ABOUT.isdisjoint(parts):
        return 2
    if not all(p in ASIDE_WORDS or p in LAYOUT_WORDS or p in NEUTRAL for p in parts):
        return 0
    return 1 if not LAYOUT_WORDS.isdisjoint(parts) else 2 * (not ASIDE_WORDS.isdisjoint(parts))


def _settle(page: Page, size: list[int]) -> None:
    """Which elements are aside, beyond those that are by their tag.

    What readers, advertisers and menus are named is aside, unless it holds a main element or the page's heading, and a form that has no text beside its labels. An element
    named by its place, a form, and an article within an article are aside unless the densest subtree of the page is theirs or in them; where an article or
    main element stands outside of them, they must hold one as well, or the heading.
    """
    n = len(page.tag)
    heads, soft = [False] * n, [False] * n
    said, nested = [0] * n, [False] * n  # text that is no label's; within an article
    label = [False] * n
    for i in range(1, n):
        label[i] = label[page.parent[i]] or page.tag[i] in ("label", "legend", "option", "button")
        nested[i] = nested[page.parent[i]] or page.tag[page.parent[i]] == "article"
        said[i] = 0 if label[i] else size[i]
    for i in range(n - 1, 0, -1):
        heads[page.parent[i]] = heads[page.parent[i]] or heads[i] or page.tag[i] in ("main", "h1")
        said[page.parent[i]] += said[i]
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        page.aside[i] = page.aside[i] or page.aside[up] or (page.marked[i] == 2 and not heads[i]) or (tag == "form" and not said[i])
        soft[i] = page.marked[i] == 1 or tag == "form" or (tag == "article" and nested[i])
    if not any(soft):
        return
    kept = [0 if page.aside[i] else size[i] for i in range(n)]
    under, story = [False] * n, list(heads)
    for i in range(1, n):
        under[i] = soft[i] or under[page.parent[i]]
    for i in range(n - 1, 0, -1):
        story[page.parent[i]] = story[page.parent[i]] or story[i] or page.tag[i] == "article"
    free = any(page.tag[i] in ("article", "main") and not under[i] and not page.aside[i] for i in range(1, n))
    at, density, _, _ = _densest(page, kept, [0] * n)
    most: dict[int, int] = {}  # the densest child of each element
    for i in range(1, n):
        up = page.parent[i]
        if density[i] > (density[most[up]] if up in most else 0):
            most[up] = i
    total = [0.0] * n
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    while at in most and 2 * density[most[at]] > total[at]:  # the child that has most of a sum counts as well
        at = most[at]
    path = set()
    while at >= 0:
        path.add(at)
        at = page.parent[at]
    for i in range(1, n):
        out = soft[i] and (i not in path or (free and not (story[i] and not nested[i])))
        page.aside[i] = page.aside[i] or page.aside[page.parent[i]] or out


def _menus(page: Page, blocks: dict[int, list[tuple[int, str]]], chars: list[int], links: list[int], inside: list[bool]) -> None:
    """Lists of short links before or after all other text of what is inside are not: menus that nothing names."""
    n = len(page.tag)
    count = [0] * n
    for i in range(n - 1, 0, -1):
        count[page.parent[i]] += count[i] + (page.tag[i] == "a" and chars[i] > 0)
    menu, own = [False] * n, [False] * n
    for i in range(1, n):
        own[i] = not menu[page.parent[i]] and page.tag[i] in ("ul", "ol", "menu", "dl", "table") and count[i] > 1 and links[i] >= LINKED * chars[i] and links[i] <= LINK_CHARS * count[i]
        menu[i] = own[i] or menu[page.parent[i]]
    if not any(menu):
        return
    told = [b for b, some in blocks.items() if any(inside[node] and not menu[node] and t.strip() for node, t in some)]
    if not told:
        return
    first, last = min(told), max(told)
    where: dict[int, bool] = {}  # whether a menu stands in between
    root = [0] * n
    for i in range(1, n):
        root[i] = i if own[i] else root[page.parent[i]]
    for b, some in blocks.items():
        for node, _ in some:
            if root[node]:
                where[root[node]] = where.get(root[node], False) or first < b < last
    for i in range(1, n):
        if root[i] and not where.get(root[i], True):
            inside[i] = False


def _densities(page: Page, size: list[int], linked: list[int]) -> tuple[list[float], list[int], list[int]]:
    """Composite text density of each element (characters per tag, damped by the share of links; zero counts stand as 1), and the characters and
    linked characters within it."""
    n = len(page.tag)
    chars, links, tags, link_tags = size[:], linked[:], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        if not page.aside[i]:
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    whole, whole_links = max(chars[0], 1), links[0]
    out = [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or page.aside[i]:
            continue
        lc, t, lt = max(links[i], 1), max(tags[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * links[i] + whole_links / whole * c + math.e)
        out[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1e-9) if base > math.e ** 1e-6 and abs(math.log(base)) > 1e-9 else c / t * math.log(max(c / lc * t / lt, 1.0) + 1)
    return out, chars, links


def _densest(page: Page, size: list[int], linked: list[int]) -> tuple[int, list[float], list[int], list[int]]:
    """The element with the largest sum of its children's densities, of equal ones the innermost, and what _densities() gives."""
    density, chars, links = _densities(page, size, linked)
    sums = [0.0] * len(page.tag)
    for i in range(1, len(page.tag)):
        sums[page.parent[i]] += density[i]
    return (max(range(len(page.tag)), key=lambda i: (sums[i], i)) if any(sums) else 0), density, chars, links


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def extract(source: str | None) -> str:
    """The article of a page: blocks in page order, white space within a block as one space, parted by two line ends.

    Scripts, styles, menus, headers, footers and asides are left out by element, what is named as something else than the article by class, id or role, and reader
    comments also as articles within an article. What is named by its place only, and forms, are left out unless the densest subtree lies in them. Of the rest the
    element with the largest sum of its children's densities is taken, or the article or main element around it; elements beside its path to the body join it if
    they are as dense as the thinnest element of that path and not mostly links. Lists of short links around all of that are menus.
    """
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    blocks: dict[int, list[tuple[int, str]]] = {}
    size, linked = [0] * n, [0] * n
    runs = [(node, block, html.unescape(raw) if "&" in raw else raw) for node, block, raw in page.runs if not page.aside[node]]
    for node, _, text in runs:
        size[node] += len(text.strip())
    _settle(page, size)
    size = [0] * n
    for node, block, text in runs:
        if page.aside[node]:
            continue
        blocks.setdefault(block, []).append((node, text))
        k = len(text.strip())
        size[node] += k
        if page.link[node]:
            linked[node] += k
    if not blocks:
        return ""
    best, density, chars, links = _densest(page, size, linked)
    path = [best]
    while path[-1] and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path) if path else 0.0
    whole = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
    top = min(whole) if whole else best
    inside = [False] * n
    inside[top] = True
    on_path = set(path)
    beside = set() if whole else set(path[path.index(top) + 1 :])
    for i in range(1, n):
        dense = page.parent[i] in beside and i not in on_path and density[i] >= threshold > 0 and 2 * links[i] < chars[i]
        inside[i] = inside[i] or inside[page.parent[i]] or dense
    if top == 0:
        inside = [True] * n
    if not whole:
        _menus(page, blocks, chars, links, inside)
    out = []
    for block in sorted(blocks):
        text = _collapsed("".join(t for node, t in blocks[block] if inside[node]))
        if text:
            out.append(text)
    return "\n\n".join(out)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a null or empty page has an empty text. Repeated rows stay, other columns go."""
    ship(pages.sparkSession)

    def each(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")
