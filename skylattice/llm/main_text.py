"""HTML extraction by tag-path ratios.

A page's text blocks are grouped by their root-to-leaf tag path (formatting tags and void tags don't count; p, li and such close
each other). For each path: letters outside links per block and punctuation marks outside links per block. Both series are
smoothed over the paths in page order, fused by their geometric mean, weighted by where the path lies, and thresholded by their own spread:
- The paths within a spread of the best are the content, and the sections that hold them are content nodes.
- So are paths that reach NEAR of the best, wherever they lie, if they reach NEAR of the content's median without smoothing as well.
- A content node's other blocks are kept unless most of their letters are links; a listed one is kept only by its own score.
- A heading goes with the text that follows it, or with the article that holds content.

Weights: inside article or main twice; LISTED for each boilerplate element around it. The fixed lists below (tag names, words of a
class, id or role) only set this weight. An element that holds HOLDS of the high-scoring letters outside
other listed ones, itself or with all that are listed for the same word, isn't boilerplate, whatever its name, unless an article or main
has such letters in no listed element. Elements named for reader comments are such only where no high-scoring letters lie outside. Of a block only the pieces in an inline element with such a word go; its other text stays. What
a browser shows no text of (scripts, styles, controls, hidden elements) is no text here either.

Defined results: null and empty html give an empty text and 0 characters. Unclosed and stray tags are tolerated, a `<` that
starts no tag is text. Pages of any length and depth take about linear time. Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template head title button select option textarea input iframe object svg canvas audio video map datalist".split())
BOILER = frozenset("nav footer aside form fieldset dialog menu legend".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "h1": ("h1",), "h2": ("h2",), "h3": ("h3",)}
SCOPE = frozenset("ul ol dl table tbody thead body html article section div main".split())
CONTENT = frozenset(("article", "main"))
SECTIONS = CONTENT | frozenset("html body div section td th blockquote header footer nav aside form".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Weight of a path for each boilerplate element around it; share of the high-scoring letters that such an element doesn't hold;
#: share of the best score that makes a path content by itself.
LISTED, HOLDS, NEAR = 0.25, 0.8, 0.5
#: Words of a class, id or role that name boilerplate.
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|promo|promoted|sponsor|sponsored|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|masthead|footer|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|comments?|commentlist|discussions?|replies|responses|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|widget|toolbar|pagination|pager|complementary|contentinfo|hidden)(?:$|[\s_-])", re.I)

#: Those of the words that name reader comments.
COMMENTS = frozenset("comment comments commentlist discussion discussions replies responses respond disqus".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|\s|/|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none""", re.I)
VALUE = re.compile(r"""(?<!style=)(?<!aria-hidden=)(?:"[^"]*"|'[^']*')""", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
MARKS = frozenset(".,;:!?…。，、！？؛،")


@dataclass(slots=True)
class Path:
    """A root-to-leaf tag path, as a node of the tree of all paths of a page; content, section and heading are the innermost ones of its elements that are such."""

    content: Path | None = None
    section: Path | None = None
    heading: bool = False
    children: dict[str, Path] = field(default_factory=dict)

    def child(self, name: str, number: int) -> Path:
        """The path of an element in this one; elements that repeat within a list or text share theirs."""
        label = name if name in ("p", "li", "td", "tr", "th", "dt", "dd") else f"{name}.{number}"
        if (found := self.children.get(label)) is None:
            found = self.children[label] = Path(self.content, self.section, self.heading or name in HEADINGS)
            if name in CONTENT:
                found.content = found
            if name in SECTIONS:
                found.section = found
        return found


@dataclass(slots=True, eq=False)
class Mark:
    """A listed element, as a node of the tree of the page's listed elements: the next one around it, its word, how many lie around it."""

    around: Mark | None
    word: str
    depth: int


@dataclass(slots=True)
class Element:
    """An open element, with what it takes over from those around it: mark is the innermost listed one, own the innermost that is no inline element; aside is True in a listed inline one."""

    name: str
    hidden: bool
    link: bool
    path: Path
    mark: Mark | None = None
    own: Mark | None = None
    aside: bool = False


@dataclass
class Block:
    """A run of text without a block element in it: where it lies, the innermost listed block element around it, and its text.

    links are those of its parts that lie in a link, asides those in a listed inline element, with the innermost listed one around each.
    """

    path: Path
    mark: Mark | None
    parts: list[str] = field(default_factory=list)
    links: set[int] = field(default_factory=set)
    asides: dict[int, Mark] = field(default_factory=dict)

    def text(self, places: Iterable[int]) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts[i] for i in places))).strip()


@dataclass
class Line:
    """A block's text, that of it outside links, and the innermost listed element around it."""

    path: Path
    text: str
    plain: str
    mark: Mark | None


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's text blocks and listed elements in page order."""
    found: list[Block] = []
    marks: list[Mark] = []
    root = Element("", False, False, Path())
    stack: list[Element] = [root]
    inside: Counter[str] = Counter()  # open elements by name: an end tag without one costs nothing
    serial, now = 0, None

    def text(piece: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.hidden:
            return
        if now is None:
            now = Block(top.path, top.own)
            found.append(now)
        if top.link:
            now.links.add(len(now.parts))
        if top.aside:
            now.asides[len(now.parts)] = top.mark
        now.parts.append(piece)

    def close(i: int) -> None:
        inside.subtract(e.name for e in stack[i:])
        del stack[i:]

    def shut(names: tuple[str, ...] | frozenset[str], within: frozenset[str]) -> None:
        if not any(inside[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return close(i)
            if stack[i].name in within:
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        inline = name in INLINE
        if not inline:
            if name == "br":
                if now is not None:
                    now.parts.append(" ")
                continue
            now = None
        if m[1]:
            if inside[name]:
                i = len(stack) - 1
                while stack[i].name != name and (not inline or stack[i].name in INLINE):
                    i -= 1
                if stack[i].name == name:
                    close(i)
            continue
        if name in CLOSES_P:
            shut(("p",), frozenset(("article", "section", "div", "td", "li", "blockquote", "body")))
        if name in CLOSES:
            shut(CLOSES[name], SCOPE - {name})
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>|$(?![\s\S])", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        serial += 1
        top = stack[-1]
        hidden = top.hidden or name in NO_TEXT or bool(HIDDEN.search(VALUE.sub("", m[3]))) and name not in ("html", "body")
        word = listed(name, m[3], top.path.content is None)
        mark = top.mark
        if word:
            mark = Mark(top.mark, word, top.mark.depth + 1 if top.mark else 1)
            marks.append(mark)
        path = top.path if inline else top.path.child(name, serial)
        stack.append(Element(name, hidden, top.link or name == "a", path, mark, top.own if inline or not word else mark, top.aside or inline and bool(word)))
        inside[name] += 1
    return found, marks


def listed(name: str, attributes: str, outside: bool) -> str:
    """The name or word by which an element is listed. Headers count only outside the article: those inside hold its title."""
    if name in BOILER or name == "header" and outside:
        return name
    if not attributes or name in ("html", "body") or name in CONTENT:
        return ""
    for value in ("".join(x) for x in NAMED.findall(attributes)):
        if m := NAMES.search(value) or outside and HEADER.search(value):
            return m[0].strip(" \t\n_-").lower()
    return ""


def smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted by a small bell over the neighbours."""
    bell = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, bell / bell.sum(), mode="valid")


def lines_of(found: list[Block]) -> list[Line]:
    """The blocks with text. A block whole in listed inline elements is listed by the innermost one that has most around it; of others these pieces go."""
    lines = []
    for b in found:
        own, mark = [i for i in range(len(b.parts)) if i not in b.asides], b.mark
        text = b.text(own)
        if not text:
            own, mark = range(len(b.parts)), max((m for i, m in b.asides.items() if b.parts[i].strip()), key=lambda m: m.depth, default=b.mark)
            text = b.text(own)
        if text:
            lines.append(Line(b.path, text, b.text(i for i in own if i not in b.links), mark))
    return lines


def scores(lines: list[Line], paths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The fused ratios of each path, smoothed and not, without the weights of listed elements."""
    letters, marks, count = (np.zeros(len(paths)) for _ in range(3))
    for x in lines:
        i = paths[id(x.path)]
        letters[i] += len(x.plain)
        marks[i] += sum(map(x.plain.count, MARKS))
        count[i] += 1
    one, two = np.log1p(letters / count), np.log1p(marks / count) + 0.1
    marked = {paths[id(x.path)] for x in lines if x.path.content}
    place = np.array([2.0 if i in marked else 1.0 for i in range(len(paths))]) * (letters > 0)
    return np.sqrt(smoothed(one) * smoothed(two)) * place, np.sqrt(one * two) * place


def listed_around(lines: list[Line], high: list[bool], marks: list[Mark]) -> dict[Mark | None, int]:
    """For each listed element (and none) how many count around its text, without those cleared: they hold HOLDS of the high-scoring letters outside other listed ones.

    Elements are cleared alone, the fullest first, and then with all of the same word; none where an article or main has such letters
    outside, and those of reader comments only where nothing has. Marks come after those around them, so sums go up and counts down the tree in one pass.
    """
    held: dict[Mark | None, int] = dict.fromkeys([None, *marks], 0)
    marked: set[Mark | None] = set()
    for x, h in zip(lines, high):
        if h:
            held[x.mark] += len(x.plain)
            if x.path.content is not None:
                marked.add(x.mark)
    whole = dict(held)
    for m in reversed(marks):
        whole[m.around] += whole[m]

    clear: set[Mark | None] = {None}
    loose, fixed = held[None], None in marked
    for m in sorted((m for m in marks if whole[m]), key=lambda m: -whole[m]):  # of equal ones the outer comes first
        if whole[m] < HOLDS * (whole[m] + loose) or fixed:
            break
        if m.around in clear and not (loose and m.word in COMMENTS):
            clear.add(m)
            loose, fixed = loose + held[m], fixed or m in marked

    words: dict[Mark | None, frozenset[str]] = {None: frozenset()}
    for m in marks:
        words[m] = words[m.around] if m in clear or m.word in words[m.around] else words[m.around] | {m.word}
    groups: Counter[frozenset[str]] = Counter()
    for m, k in held.items():
        groups[words[m]] += k
    stuck = {words[m] for m in marked}
    mass = Counter({w: sum(k for group, k in groups.items() if w in group) for w in set().union(*groups)})
    free: set[str] = set()
    for word, k in sorted(mass.items(), key=lambda x: (-x[1], x[0])):
        loose = sum(n for group, n in groups.items() if group <= free)
        if not k or k < HOLDS * (k + loose) or any(group <= free for group in stuck):
            break
        if not (loose and word in COMMENTS):
            free.add(word)

    count: dict[Mark | None, int] = {None: 0}
    for m in marks:
        count[m] = count[m.around] + (m not in clear and m.word not in free)
    return count


def extract(page: str | None) -> str:
    """The main text; its blocks joined by line breaks."""
    found, marks = blocks(page or "")
    lines = lines_of(found)
    if not lines:
        return ""
    paths = {p: i for i, p in enumerate(dict.fromkeys(id(x.path) for x in lines))}
    fused, own = scores(lines, paths)
    at = [paths[id(x.path)] for x in lines]
    around = listed_around(lines, [fused[i] >= NEAR * fused.max() for i in at], marks)
    weight = np.array([LISTED ** around[x.mark] for x in lines])
    fused, own = fused[at] * weight, own[at] * weight
    best = fused.max()
    if best <= 0:  # there is no text outside links
        return "\n".join(x.text for x, w in zip(lines, weight) if w == 1)
    passing = fused >= best - fused[np.unique(at, return_index=True)[1]].std()
    alone = (fused >= NEAR * best) & (own >= NEAR * np.median(own[passing]))
    nodes = {id(x.path.section) for x, p in zip(lines, passing) if p}
    articles = {id(x.path.content) for x, p in zip(lines, passing) if p and x.path.content}
    stays, follows = [False] * len(lines), False
    for i in range(len(lines) - 1, -1, -1):
        x = lines[i]
        inside = weight[i] == 1 and (id(x.path.section) in nodes or id(x.path.content) in articles)
        if x.path.heading:
            stays[i] = inside or bool(weight[i] == 1 and follows)
        else:
            follows = stays[i] = bool(passing[i] or alone[i] or inside and 2 * len(x.plain) >= len(x.text))
    return "\n".join(x.text for x, stay in zip(lines, stays) if stay)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
