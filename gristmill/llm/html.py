"""Main text of web pages by tag-path ratios.

Every run of text hangs on a root-to-leaf tag path. Per path the page's text length, punctuation,
linked length and number of runs are summed; text and punctuation per run are the path's ratios.
Each run takes its path's ratios, which are smoothed over neighbouring runs and fused into one
weight; runs over a share of the page's mean weight are content. The outermost article or main that
holds most of the content is the article; without one it is the smallest element that does, widened
to its headings and up to the parts of the page's frame. Its other runs belong to it too, unless they
stand in a part that is marked as no content (menus, forms, adverts and the like). A mark does not
count on a part that holds the page's article or most of its text, nor, where the name is doubtful
(related-work, side-by-side), on a part whose own ratios reach the page's mean weight. The only h1 of
a page stays though a banner holds it. What nothing marks and whose ratios are those of an article,
such as a notice or comments with names that say nothing, can't be told from it by one page.

Defined results: a null or empty page has an empty text; repeated rows are rows like others; pages of
any length or depth are read whole, in time linear in both; only the three columns are read, so that
others may have any name; an empty table gives no rows.

Scale: one narrow pass over the pages, one page in memory at a time, no shuffle. Paths are numbers, and
what is known of an element is passed down or summed up once, so that deep nesting costs no more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed lists from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object select title xmp noembed noframes audio video".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Parts that are no content: by tag, and by words in class, id or role.
NO_CONTENT = frozenset("nav footer aside form head button dialog menu".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|side|aside|ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|banner|comment|comments|disqus|reply|replies|respond|cookie|cookies|consent|notice|alert|popup|modal|overlay|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|breadcrumb|breadcrumbs|pagination|pager|toolbar|widget|masthead|skip|copyright|contentinfo|complementary)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^<>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[,.;:!?、。，；：？！…]")
#: Marks of parts that may hold more text than the article does.
THREAD = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|reply|replies|respond|related|recommended)(?:$|[\s_-])", re.I)
#: Marks that other names are made of as well, such as related-work and side-by-side: there the ratios decide.
AMBIGUOUS = frozenset("side related recommended search notice alert banner promo share sharing social widget ad ads sponsored respond reply skip overlay toolbar menu consent login signup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
ROOT = frozenset(("", "html", "body"))
SMOOTH = (1, 2, 1)
#: Share of the page's mean weight from which a run is content; share of the weight that the article holds.
CUT, HOLDS = 0.5, 0.8


class Part:
    """An element: its path's number, whether it is no content, its own mark (0 none, 1 fixed, 2 may be lifted, 3 of a thread), whether its name leaves that open, its nearest block and its parent."""

    __slots__ = ("tag", "path", "out", "marked", "words", "open", "link", "up", "depth", "block", "inside")

    def __init__(self, tag: str, path: int, marked: int, up: Part | None, words: bool = False, open_: bool = False):
        self.tag, self.path, self.up, self.depth = tag, path, up, up.depth + 1 if up else 0
        self.words, self.open = words, open_
        self.marked, self.out, self.link = marked, bool(marked or up and up.out), tag == "a" or bool(up and up.link)
        self.block: Part = self if tag in BLOCK or up is None else up.block
        self.inside = tag in ARTICLE or bool(up and up.inside)

    def line(self) -> Iterator[Part]:
        """The element and its parents, inside out."""
        p: Part | None = self
        while p:
            yield p
            p = p.up


def tree(found: list[tuple[str, Part, int]]) -> list[Part]:
    """All elements that hold a run, parents before children."""
    seen: set[Part] = set()
    for _, part, _ in found:
        for p in part.line():
            if p in seen:
                break
            seen.add(p)
    return sorted(seen, key=lambda p: p.depth)


def down(parts: list[Part], step: Callable[[Part, Any], Any], start: Any = None) -> dict[Part | None, Any]:
    """By element a value made of the element and its parent's value."""
    out: dict[Part | None, Any] = {None: start}
    for p in parts:
        out[p] = step(p, out[p.up])
    return out


def up(parts: list[Part], first: Iterable[tuple[Part, int]]) -> dict[Part, int]:
    """By element the sum of its own and its children's values; only of elements that have any."""
    out: dict[Part, int] = {}
    for p, n in first:
        out[p] = out.get(p, 0) + n
    for p in reversed(parts):
        if p in out and p.up:
            out[p.up] = out.get(p.up, 0) + out[p]
    return out


def own_header(p: Part) -> bool:
    """No mark, or that of a header by its tag alone, which may be the article's own."""
    return not p.marked or p.tag == "header" and p.marked == 2 and not p.words


def doubtful(label: str) -> bool:
    """Whether each marked name in a label is made of an ambiguous mark and some other word."""
    for name in label.split():
        if MARKS.search(name):
            words = [w for w in re.split(r"[_-]+", name.lower()) if w]
            if all(MARKS.search(w) for w in words) or any(MARKS.search(w) and w not in AMBIGUOUS for w in words):
                return False
    return True


def lift(found: list[tuple[str, Part, int]]) -> None:
    """Takes words' marks off parts that hold the page's main or only article, or most of the text outside fixed marks."""
    if not any(part.out for _, part, _ in found):
        return
    parts = tree(found)
    fixed = down(parts, lambda p, above: above or p.marked == 1, False)
    outer = down(parts, lambda p, above: above or (p if p.tag in ARTICLE else None))
    open_runs = [(len(text), part, linked) for text, part, linked in found if not fixed[part]]
    mass = up(parts, ((part, max(0, n - 2 * linked)) for n, part, linked in open_runs))
    below = {t: up(parts, ((p.up, 1) for p in parts if p.tag == t and p in mass and p.up)) for t in ("main", "h1")}
    articles = {outer[part] for _, part, _ in open_runs} - {None}
    whole = max(mass.values(), default=0)
    only = {p for a in articles if len(articles) == 1 for p in a.line()}
    free = set()
    for p, n in mass.items():
        if p.marked > 1:
            most = n * 2 > whole
            if p in below["main"] or (p.marked == 2 and (most or p in only)) or (p.marked == 3 and most and (p in below["h1"] or p in only)):
                free.add(p)
    if free:
        for p, out in down(parts, lambda p, above: above or bool(p.marked and p not in free), False).items():
            if p:
                p.out = out


def runs(html: str) -> list[tuple[str, Part, int]]:
    """(text, element, linked characters) of each block of text in page order."""
    out: list[tuple[str, Part, int]] = []
    stack = [Part("", 0, 0, None)]
    paths: dict[tuple[int, str], int] = {}  # number of each path by its parent's and its last step
    opened: Counter = Counter()  # open elements by tag, and inline ones by their block and tag
    text: list[str] = []
    owner, linked = stack[0], 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append((whole, owner, linked))
            text.clear()
        linked = 0

    def drop(i: int) -> None:
        """Closes all elements from the i-th on."""
        for p in stack[i:]:
            opened[p.tag] -= 1
            opened[p.block, p.tag] -= 1
        del stack[i:]

    def add(piece: str) -> None:
        nonlocal owner, linked
        if piece:
            if not text or (len(text) < 3 and not "".join(text).strip()):
                owner = stack[-1].block
            text.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    at, end = 0, len(html)
    close = html.rfind(">") + 1  # no tag ends after it
    last = html.rfind("<!--")
    while at < end:
        m = TOKEN.search(html, at, end if last >= at else close) if at < max(close, last) else None
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag] if tag in BLOCK else opened[stack[-1].block, tag]:  # an inline end tag does not close blocks
                drop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        attributes = m[3] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = shut.end() if shut else end
            text.append(" ") if text else None
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "wbr") and text and tag == "br":
                text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack[-1].block.tag == "p":  # a block ends an open paragraph and what is open in it
                drop(stack[-1].block.depth)
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    drop(i)
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        named = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)] if attributes else []
        label = " ".join(v for _, v in named)
        words = bool(label and tag not in ROOT | ARTICLE and MARKS.search(label))
        if tag in NO_CONTENT and tag != "form" or attributes and HIDDEN.search(attributes):
            no = 1
        elif words and THREAD.search(label):
            no = 3
        else:
            no = 2 if words or tag == "form" or tag == "header" and not stack[-1].inside else 0
        mark = "." + ".".join(sorted(v for k, v in named if k == "class")) if any(k == "class" for k, _ in named) else ""
        stack.append(Part(tag, paths.setdefault((stack[-1].path, tag + mark), len(paths) + 1), no, stack[-1], words, words and tag != "form" and no != 1 and doubtful(label)))
        opened[tag] += 1
        opened[stack[-1].block, tag] += 1
    flush()
    lift(out)
    return out


def ratios(found: list[tuple[str, Part, int]]) -> dict[int, tuple[float, float]]:
    """By path the text, less what is linked, and the punctuation of a run."""
    totals: dict[int, list[float]] = {}
    for text, part, linked in found:
        t = totals.setdefault(part.path, [0, 0, 0])
        t[0] += max(0, len(text) - 2 * linked)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += 1
    return {path: (a / n, b / n) for path, (a, b, n) in totals.items()}


def weights(found: list[tuple[str, Part, int]]) -> list[float]:
    """Fused weight of each run from its path's smoothed ratios; runs in marked parts have none."""
    by_path = ratios(found)
    ratio = [(0.0, 0.0) if part.out else by_path[part.path] for _, part, _ in found]

    def smooth(x: list[float]) -> list[float]:
        wide = [x[0], *x, x[-1]]
        return [sum(w * v for w, v in zip(SMOOTH, wide[i : i + 3], strict=True)) / sum(SMOOTH) for i in range(len(x))]

    if not found:
        return []
    length, marks = smooth([r[0] for r in ratio]), smooth([r[1] for r in ratio])
    return [0.0 if part.out else a * (1 + b) for (_, part, _), a, b in zip(found, length, marks, strict=True)]


def readmit(found: list[tuple[str, Part, int]], mean: float) -> bool:
    """Takes the marks off parts with a doubtful name of which most text has ratios of at least the page's mean weight."""
    parts = tree(found)
    # the outermost part with a mark, if no other kind of mark is on the way to the run
    own = down(parts, lambda p, above: above if above is not None and not p.marked else (above or p) if p.marked and p.open and above is not False else False if p.marked else above)
    by_path = ratios(found)
    mass: dict[Part, list[int]] = {}
    for text, part, linked in found:
        if part.out and own[part]:
            a, b = by_path[part.path]
            m = mass.setdefault(own[part], [0, 0])
            m[0] += len(text)
            m[1] += len(text) if a * (1 + b) >= mean and 2 * linked < len(text) else 0
    free = {p for p, (whole, good) in mass.items() if 2 * good >= whole}
    if free:
        for p, out in down(parts, lambda p, above: above or bool(p.marked and not (p.open and own[p] in free)), False).items():
            if p:
                p.out = out
    return bool(free)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by a newline; empty if there is none."""
    found = runs(html or "")
    weight = weights(found)
    usable = [w for w in weight if w > 0]
    if not usable:
        return ""
    if readmit(found, sum(usable) / len(usable)):
        weight = weights(found)
        usable = [w for w in weight if w > 0]
    cut = CUT * sum(usable) / len(usable)
    parts = tree(found)
    article = find_article(found, parts, weight, cut)
    inside = down(parts, lambda p, above: above or p is article, False)
    # what stands in the article and in no marked part of it
    own = down(parts, lambda p, above: p is article and not p.out and p.tag not in ROOT or above and (own_header(p) or p.open and not p.out), False)
    titles = [i for i, (_, part, _) in enumerate(found) if part.tag == "h1"]
    title = titles[0] if len(titles) == 1 and headline(found[titles[0]][1]) else -1
    keep = []
    for i, ((text, part, _), w) in enumerate(zip(found, weight, strict=True)):
        if i == title or own[part] or not part.out and (inside[part] or article is None or w >= cut):
            keep.append(text)
    return "\n".join(keep)


def headline(part: Part) -> bool:
    """Whether a page's only h1 is the article's although a part with a name like banner holds it: no fixed mark and no thread is around it."""
    marks = [p for p in part.line() if p.marked]
    return bool(marks) and all(p.marked == 2 and p.words and p.tag not in ("header", "form") for p in marks)


def find_article(found: list[tuple[str, Part, int]], parts: list[Part], weight: list[float], cut: float) -> Part | None:
    mass = up(parts, ((part, len(text)) for (text, part, _), w in zip(found, weight, strict=True) if w >= cut))
    most = HOLDS * max(mass.values(), default=0)
    large = [p for p, n in mass.items() if n >= most and p.tag not in ("p", "li", "td", "pre", "blockquote") and p.tag not in HEADINGS]
    marked = [p for p in large if p.tag in ARTICLE]
    if marked:
        return min(marked, key=lambda p: p.depth)
    article = max(large, key=lambda p: p.depth, default=None)
    if article is None:
        return None
    plain = down(parts, lambda p, above: above and (not p.marked or p.tag == "header" and not p.words), True)
    heading = down(parts, lambda p, above: above or p.tag in HEADINGS, False)
    headed = up(parts, ((part, 1) for _, part, _ in found if plain[part] and heading[part]))  # with a heading that is not the page's own header
    framing = up(parts, ((part, 1) for _, part, _ in found if not plain[part]))  # with marked parts
    framed = Counter(p.up for p in framing)
    while article.up and article.up.tag not in ROOT and framed[article.up] == (article in framing):
        article = article.up
    if article not in headed:
        article = next((p for p in article.line() if p in headed), article)
    return article


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_key", "_url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of pages: key, url, text, n_chars. A null or empty page has an empty text. No rows for an empty table."""
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("html"))
    out = rows.mapInArrow(_extract, "_key bigint, _url string, text string, n_chars bigint")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
