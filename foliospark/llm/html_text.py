"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block tags from the root to it. Parts
that are something else than the article (navigation, forms, adverts, comments and so on) are
left out first; one that is so by its class, id or role alone stays when it holds half of the
page, or a main heading or the largest article with a tenth of the text and the article is longer
than all text outside such parts. Then, for every path, text length and punctuation are summed up over
its blocks and divided by their number; the two ratios are smoothed in page order, fused, and
paths are content when their mean reaches a share of the page's standard deviation. A short
paragraph is content because its path is. The content blocks point out the article: the
``article`` or ``main`` element around them, or else their nearest common element, of which
all remaining blocks are the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.texts import bounded_batches

#: Share of the standard deviation of the fused ratios that a content path reaches.
THRESHOLD = 0.8
#: Shares of the page's text with which a block stays whatever its name: of text and punctuation
#: alike, and of text with the largest article or a main heading.
MOST, SOME = 0.5, 0.1

# Element names of HTML.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe",
                 "xmp", "noembed", "noframes", "svg", "math"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "source", "track", "wbr"))
#: Elements that are closed when another one of the set opens beside them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
            "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAVES = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "td", "th", "tr", "tbody", "thead",
                     "table", "blockquote", "pre", "figure", "figcaption"}

#: Elements that are never part of an article.
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "select", "dialog", "menu",
                        "fieldset", "search", "object", "applet", "canvas", "audio", "video",
                        "datalist", "head"))
#: Words of a class, id or role that name something else than the article.
OTHER_WORDS = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "copyright", "disqus", "footer", "gdpr", "login", "menu", "menubar", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets", "alert", "masthead"))
#: Beginnings of class names that say what an element has, not what it is.
HAS = ("has-", "with-", "no-", "is-", "has_", "with_", "no_", "is_")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(
    r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:"""
    r"""\s*none)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？।؟،]")


class _Element:
    __slots__ = ("tag", "parent", "path", "depth", "named")

    def __init__(self, tag: str, parent: _Element | None, named: bool = False):
        self.tag, self.parent, self.named = tag, parent, named
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.depth = parent.depth + 1 if parent else 0

    def around(self):
        at = self
        while at:
            yield at
            at = at.parent


def _is_other(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in OTHER_TAGS or tag == "header" and not inside_article:
        return True
    return tag not in ("html", "body") and bool(_HIDDEN.search(attributes))


def _is_named(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether a class, id or role says that it is something else than the article."""
    if not attributes or tag in ("html", "body"):
        return False
    for kind, *values in _NAMES.findall(attributes):
        for name in "".join(values).lower().split():
            words = _WORDS.findall(name) if not name.startswith(HAS) else ()
            if not OTHER_WORDS.isdisjoint(words) or "header" in words and not inside_article:
                return True
    return False


def blocks_of(html: str) -> list[tuple[_Element, str]]:
    """(element, text) of the blocks of a page that may belong to its article."""
    root = _Element("", None)
    at, out, held = root, [], []
    skipped, depth, until = None, 0, 0                # element being left out; end of raw text

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((at, text))

    place = 0
    for mark in _MARKUP.finditer(html):
        if mark.start() < until:
            continue
        if not skipped:
            held.append(html[max(place, until):mark.start()])
        place = mark.end()
        tag = mark[2] or mark[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), bool(mark[1] or mark[4]), mark[3] or mark[6] or ""
        if skipped:
            if tag == skipped and tag not in VOID:
                depth += -1 if ending else 1
                if depth == 0:
                    skipped = None
                continue
            loose = skipped in ("p", "li", "dt", "dd", "td", "th", "option") or skipped not in BLOCKS
            outer = ending and any(e.tag == tag for e in at.around())
            if not (outer or loose and tag in BLOCKS and skipped == "p"):
                continue
            skipped = None
        if tag in RAW and not ending:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, mark.end())
            place = until = end.start() if end else len(html)
            continue
        if tag in ("br", "hr"):
            close()
        elif ending:
            if tag in BLOCKS:
                close()
                for element in at.around():
                    if element.tag == tag:
                        at = element.parent
                        break
        elif tag not in VOID:
            inside = any(e.tag in ("article", "main") for e in at.around())
            if tag in BLOCKS:
                close()
                at = _implied_end(at, tag)
            named = _is_named(tag, attributes, inside)
            if (_is_other(tag, attributes, inside) or named and tag not in BLOCKS) \
                    and not attributes.endswith("/"):
                skipped, depth = tag, 1
            elif tag in BLOCKS:
                at = _Element(tag, at, named and not attributes.endswith("/"))
    if not skipped:
        held.append(html[max(place, until):])
    close()
    return _without_named(out)


def _without_named(blocks: list[tuple[_Element, str]]) -> list[tuple[_Element, str]]:
    """The blocks but for those inside an element that its name and its share rule out."""
    if not any(x.named for e in {e for e, _ in blocks} for x in e.around()):
        return blocks
    length, marks, heading = defaultdict(int), defaultdict(int), set()
    for element, text in blocks:
        n, m = len(text), len(_PUNCTUATION.findall(text))
        title = False
        for x in element.around():
            title |= x.tag == "h1"
            if x.named or x.tag in ("article", "main") or not x.parent:
                length[x] += n
                marks[x] += m
                if title:
                    heading.add(x)
    root = next(x for x in blocks[0][0].around() if not x.parent)
    articles = [x for x in length if x.tag in ("article", "main")]
    # Of those of one size the outermost, or else the first.
    largest = max(articles, key=lambda x: (length[x], -x.depth), default=None)
    # One in a named block counts only if it is longer than all that is in none.
    plain = sum(len(t) for e, t in blocks if not any(x.named for x in e.around()))
    if largest and (length[largest] < SOME * length[root] or length[largest] < plain
                    and any(x.named for x in largest.around())):
        largest = None
    holders = set(largest.around()) if largest else set()

    def stays(x: _Element) -> bool:
        if x in holders or x in heading and length[x] >= SOME * length[root]:
            return True
        # An article elsewhere is the article, however long the comments are.
        elsewhere = largest and x not in holders and largest not in x.around()
        return not elsewhere and length[x] >= MOST * length[root] and marks[x] >= MOST * marks[root]

    gone = {x for x in length if x.named and not stays(x)}
    return [(e, t) for e, t in blocks if gone.isdisjoint(e.around())]


def _implied_end(at: _Element, tag: str) -> _Element:
    """The parent of a new block, after what it closes."""
    if at.tag == "p" or at.tag in HEADINGS and tag in HEADINGS:
        at = at.parent
    if tag in SIBLINGS:
        for element in at.around():
            if element.tag in SIBLINGS[tag]:
                return element.parent
            if element.tag in ("ul", "ol", "dl", "table", "select", "div"):
                break
    return at


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(2 * v + (values[i - 1] if i else v) + (values[i + 1] if i + 1 < n else v)) / 4
            for i, v in enumerate(values)]


def content_paths(blocks: list[tuple[_Element, str]], threshold: float = THRESHOLD) -> set[str]:
    """Paths whose smoothed and fused text and punctuation ratios make them content."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for element, text in blocks:
        count[element.path] += 1
        length[element.path] += len(text)
        marks[element.path] += len(_PUNCTUATION.findall(text))
    paths = [e.path for e, _ in blocks]
    text_ratio = _smooth([length[p] / count[p] for p in paths])
    mark_ratio = _smooth([marks[p] / count[p] for p in paths])
    fused = [t * (1 + m) for t, m in zip(text_ratio, mark_ratio)]
    total = defaultdict(float)
    for p, f in zip(paths, fused):
        total[p] += f
    mean = {p: total[p] / count[p] for p in total}
    if not fused:
        return set()
    middle = sum(fused) / len(fused)
    least = threshold * (sum((f - middle) ** 2 for f in fused) / len(fused)) ** 0.5
    best = max(mean.values())
    return {p for p, m in mean.items() if m >= min(least, best)}


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page: white space of a block is one blank, blocks are joined by one."""
    blocks = blocks_of(html or "")
    chosen = content_paths(blocks, threshold)
    content = [e for e, _ in blocks if e.path in chosen]
    for names in (("article",), ("main",)):
        around = {next((x for x in e.around() if x.tag in names), None) for e in content} - {None}
        if around:
            return " ".join(t for e, t in blocks if any(x in around for x in e.around()))
    if not content:
        return ""
    common = content[0]
    for element in content[1:]:
        have = set(element.around())
        common = next(x for x in common.around() if x in have)
    while common.tag in LEAVES:
        common = common.parent
    if common.tag in ("", "html", "body"):
        # No element of its own: content paths, and headings among or right before them.
        where = [i for i, (e, _) in enumerate(blocks) if e.path in chosen]
        first = where[0]
        while first and blocks[first - 1][0].tag in HEADINGS:
            first -= 1
        return " ".join(t for i, (e, t) in enumerate(blocks) if e.path in chosen
                        or e.tag in HEADINGS and first <= i <= where[-1])
    return " ".join(t for e, t in blocks if common in e.around())


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) per row; a null page has an empty text. Rows may repeat,
    and any other columns are left alone."""
    def read(batches):
        for batch in batches:
            text = [main_text(h, threshold) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = bounded_batches(pages).select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, "
                                  "n_chars bigint")
