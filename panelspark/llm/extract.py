"""Main-text extraction from HTML by tag-path ratios.

A page is cut into text blocks, each with its path of block tags from the root.
For every path two ratios are summed up: characters of text outside links per
block, and punctuation per block. Both are smoothed over the blocks in page
order (neighbours of content tend to be content), fused by multiplication, and
paths whose fused ratio exceeds a threshold (a share of the spread over the
page) are the content nodes.

Content nodes decide three things. Where no article or main with text is free
of marks, an element that is marked as something else (navigation, sidebar, form
and so on, by its tag or by a whole word of class, id or role) is taken as marked
only if it doesn't hold most content characters of the page; adverts, notices and
comments of readers stay marked. The nearest
container of the content nodes that aren't marked is the article. Of the other
blocks in it, short ones such as headings belong to it as well, but paths of
nothing but links go, unless the page names its article.

Everything is linear in the page: one pass over the markup, elements numbered so
that parents come before children, and sums over subtrees from the last to the
first.

Edge cases: null html is empty; pages without any text give an empty text and
zero characters; unclosed, misnested and unknown tags, comments, quotes that
are never closed and broken markup are read as browsers do, roughly; long pages
are read whole; repeated rows each get their row; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Fixed values of HTML: elements without content, without text of the page, inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style noscript template textarea title iframe svg math xmp noembed noframes object canvas audio video "
    "select button".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var nobr picture map img input embed area source track param wbr link meta base".split()
)
#: What ends an open element of the given kind without an end tag.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body ul ol dl table div article section main aside nav header footer form td th blockquote".split())
#: Parts of a text that hold no article by themselves.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd blockquote pre figure figcaption address".split())
#: Elements that aren't the article, and words that say so in a class, id or role.
OTHER_TAGS = frozenset("nav footer aside form head menu dialog fieldset".split())
SOFT_WORDS = re.compile(
    r"nav|navs|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|footers?|masthead|alerts?|popups?|modal|newsletter|"
    r"subscribe|share|sharing|social|related|recommend(?:ed|ations?)|widgets?|toolbar|pagination|pager|login|search|"
    r"contentinfo|complementary|skip|copyright|legal"
)
FIRM_WORDS = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|notices?|comments?|respond|replies|disqus")
#: Words that a name may end with, or that turn a mark into a trait of a wrapper.
STRUCTURE = frozenset(
    "area articles bar block body bottom box button buttons col column container content field form frame grid group "
    "head header heading holder icon icons info inner item items left link links list main mobile module outer panel "
    "placeholder posts primary region right row secondary section slot stories text title top unit wrap wrapper zone".split()
)
TRAITS = frozenset("and has have hide hides is no non not on show shows with without".split())
SITE_HEADER = re.compile(r"(?:site|page|global|top)[-_]?header")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNTIL = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
UNSHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
RAW_END = re.compile(rf"(?i)</({'|'.join(sorted(RAW))})(?=[\s/>])")
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،·¿¡]")
#: Weights of the neighbours while smoothing, and the threshold in spreads.
KERNEL, SPREADS = np.array([0.25, 0.5, 0.25]), 0.25
#: Shares of content characters that make a container, and that lift a mark; the
#: share of a path's characters in links from which it is a menu.
HELD, MOST, LINKED = 0.9, 0.5, 0.9
SOFT, FIRM = 1, 2


def mark_of(name: str) -> int:
    """Whether a class, id or role says that an element isn't the article.

    The last word counts that isn't merely structural, so ``left-sidebar`` and
    ``sidebar-box`` are sidebars, ``has-sidebar`` and ``search-engines`` nothing.
    """
    if SITE_HEADER.fullmatch(name.lower()):
        return SOFT
    words = [w.lower() for w in WORDS.split(name)]
    while words:
        word = words.pop()
        firm = FIRM_WORDS.fullmatch(word)
        if firm or SOFT_WORDS.fullmatch(word):
            return 0 if TRAITS.intersection(words) else FIRM if firm else SOFT
        if word and word not in STRUCTURE and not word[0].isdigit():
            return 0
    return 0


@dataclass
class Element:
    tag: str
    number: int
    path: int
    link: bool


@dataclass
class Block:
    """Text between two borders of block elements, with the elements that its
    parts stand in."""

    owner: int
    path: int
    parts: list[tuple[int, str, bool]] = field(default_factory=list)


class Page:
    """The blocks and elements of a page; element 0 is the page itself.
    ``named`` tells what lies within an article or main."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.mark, self.tag, self.named = [0], [0], [""], [False]
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        root = Element("", 0, 0, False)
        stack: list[Element] = []
        open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        blocks_at: list[int] = []  # places of block elements
        current: Block | None = None
        at, size, quotes = 0, len(page), True
        last_cdata = page.rfind("]]>")
        raw_ends: dict[str, list[int]] = defaultdict(list)
        for m in RAW_END.finditer(page):
            raw_ends[m[1].lower()].append(m.start())

        def text(raw: str, decode: bool = True) -> None:
            nonlocal current
            if not raw:
                return
            top = stack[-1] if stack else root
            if current is None:
                owner = stack[blocks_at[-1]] if blocks_at else root
                current = Block(owner.number, owner.path)
                self.blocks.append(current)
            current.parts.append((top.number, entities.unescape(raw) if decode and "&" in raw else raw, top.link))

        def cut(place: int) -> None:
            while len(stack) > place:
                gone = stack.pop()
                open_at[gone.tag].pop()
                if blocks_at and blocks_at[-1] == len(stack):
                    blocks_at.pop()

        def top_of(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

        def close(tags, scopes) -> None:
            place = top_of(tags)
            if place >= 0 and place > top_of(scopes - tags):
                cut(place)

        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                text(page[at:])
                break
            text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
                continue
            if page.startswith("<![CDATA[", lt) and lt < last_cdata:
                end = page.find("]]>", lt)
                text(page[lt + 9 : end], decode=False)
                at = end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
                continue
            m = NAME.match(page, lt)
            if m is None:
                text("<")
                at = lt + 1
                continue
            # the end of the tag: a quoted value may hold >, unless a quote is never closed
            begin = at = m.end()
            end = -1
            while quotes and end < 0:
                q = UNTIL.search(page, at)
                if q and q[1] is None:
                    end = q.end()
                    break
                at = page.find(q[1], q.end()) + 1 if q else 0
                quotes = at > 0
            if end < 0:
                end = page.find(">", begin) + 1 or size
            attributes, at = page[begin : end - 1], end
            tag = m[2].lower()
            block = tag not in INLINE
            if m[1]:
                if tag != "br" and open_at[tag]:
                    place = open_at[tag][-1]
                    if block or not blocks_at or blocks_at[-1] < place:
                        cut(place)
                if block and tag not in RAW:
                    current = None
                continue
            if tag in RAW:
                ends = raw_ends[tag]
                i = bisect_left(ends, at)
                if i < len(ends):
                    at = page.find(">", ends[i]) + 1 or size
                elif tag in ("script", "style"):
                    at = size
                continue
            if block:
                current = None
            if tag in ENDS_P:
                close({"p"}, SCOPES)
            if tag in SAME_LEVEL:
                close(SAME_LEVEL[tag], SCOPES)
            if tag in VOID or (block and tag not in ENDS_P and attributes.rstrip().endswith("/")):
                continue
            up = stack[-1] if stack else root
            number = len(self.parent)
            path = self._paths.setdefault((up.path, tag), len(self._paths) + 1) if block else up.path
            self.parent.append(up.number)
            self.tag.append(tag)
            self.mark.append(self._mark(tag, attributes, self.named[up.number]))
            open_at[tag].append(len(stack))
            if block:
                blocks_at.append(len(stack))
            self.named.append(self.named[up.number] or tag in ("article", "main"))
            stack.append(Element(tag, number, path, up.link or tag == "a"))

    @staticmethod
    def _mark(tag: str, attributes: str, named: bool) -> int:
        mark = SOFT if tag in OTHER_TAGS or (tag == "header" and not named) else 0
        if not attributes or attributes.isspace():
            return mark
        found: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(attributes):
            found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSHOWN.search(found.get("style", "")):
            return FIRM
        if tag in ("html", "body", "article", "main"):
            return mark
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split()
        return max([mark, *map(mark_of, names)])

    def inherited(self, own: list[int]) -> list[int]:
        """For each element the mark of itself or of what it stands in."""
        out = list(own)
        for i in range(1, len(out)):
            out[i] = max(out[i], out[self.parent[i]])
        return out

    def sums(self, own: list[int]) -> list[int]:
        """For each element the sum over itself and all in it."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def ratios(paths: list[int], texts: list[str], linked: list[int]) -> np.ndarray:
    """The fused, smoothed ratio of the path of each block."""
    known = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([known[p] for p in paths])
    size = np.array([max(0, len(t) - n) for t, n in zip(texts, linked)], float)
    marks = np.array([len(PUNCTUATION.findall(t)) if s else 0 for t, s in zip(texts, size)], float)
    n = np.bincount(of, minlength=len(known))
    fused = np.ones(len(texts))
    for x in (size, marks + 0.1):
        per_path = np.bincount(of, x, len(known)) / n
        padded = np.pad(per_path[of], 1, mode="edge")
        smooth = np.convolve(padded, KERNEL, mode="valid")
        # of a path's blocks the smoothed ratios are averaged again
        fused *= (np.bincount(of, smooth, len(known)) / n)[of]
    return fused


def content_of(fused: np.ndarray) -> np.ndarray:
    """Which blocks are content nodes."""
    return (fused >= SPREADS * fused.std()) & (fused > 0)


def extract(page: str | None) -> str:
    """Main text of a page: its blocks, joined by one space."""
    tree = Page(page or "")

    def texts(blocks: list[Block], gone: list[int]) -> list[tuple[Block, str, int]]:
        """Blocks with text, their text and its characters in links, without the elements that are gone."""
        out = []
        for b in blocks:
            parts = [(t, link) for e, t, link in b.parts if not gone[e]]
            said = SPACES.sub(" ", "".join(t for t, _ in parts)).strip()
            if said:
                out.append((b, said, sum(len(t.strip()) for t, link in parts if link)))
        return out

    def content(found: list[tuple[Block, str, int]]) -> np.ndarray:
        return content_of(ratios([b.path for b, _, _ in found], [t for _, t, _ in found], [n for _, _, n in found]))

    gone = tree.inherited(tree.mark)
    shown = texts(tree.blocks, gone)
    if any(tree.mark) and not any(tree.named[b.owner] for b, _, _ in shown):
        # content characters tell which marks are to be believed
        whole = texts(tree.blocks, tree.inherited([m * (m == FIRM) for m in tree.mark]))
        weight = [0] * len(tree.parent)
        for (b, t, _), good in zip(whole, content(whole) if whole else ()):
            weight[b.owner] += len(t) * bool(good)
        held = tree.sums(weight)
        gone = tree.inherited([0 if m == SOFT and w > MOST * held[0] else m for m, w in zip(tree.mark, held)])
        shown = texts(tree.blocks, gone)
    if not shown:
        return ""

    # the deepest element that holds nearly all content characters
    good = content(shown)
    if not good.any():
        good[:] = True
    weight = [0] * len(tree.parent)
    for (b, t, _), g in zip(shown, good):
        weight[b.owner] += len(t) * bool(g)
    held = tree.sums(weight)
    container = max(i for i, w in enumerate(held) if w >= HELD * held[0])
    line = [container]
    while line[-1]:
        line.append(tree.parent[line[-1]])
    named = next((e for e in line if tree.tag[e] in ("article", "main")), None)
    if named is None:
        container = next((e for e in line if tree.tag[e] not in PARTS), 0)
    else:
        container = named
    inside = tree.inherited([int(i == container) for i in range(len(tree.parent))])
    kept = [x for x in zip(shown, good) if inside[x[0][0].owner]]
    if named is None:  # a path of links alone is a menu
        size: dict[int, int] = defaultdict(int)
        links: dict[int, int] = defaultdict(int)
        for (b, t, n), _ in kept:
            size[b.path] += len(t)
            links[b.path] += n
        content_paths = {b.path for (b, _, _), g in kept if g}
        kept = [x for x in kept if x[0][0].path in content_paths or links[x[0][0].path] < LINKED * size[x[0][0].path]]
    return " ".join(t for (_, t, _), _ in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``page_id, url, html``; no shuffle."""

    def make():
        def row(r):
            text = extract(r["html"])
            return [(r["page_id"], r["url"], text, len(text))]

        return row

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages, make, ["page_id", "url", "html"], f"page_id {kind}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
