"""Main-text extraction: parser events become lines, the lines' text-to-tag ratios choose the content region.

The standard library's parser streams events into blocks (lines): each has its text, the number of tags since the line
before and the open elements. Elements that are never article text (menus, headers, footers, sidebars, notices,
adverts, scripts, styles, reader comments; by tag, role, or words of class and id) are left out as they open. Inside an
article or main element only whole words of CLEAR count, and no heading or section goes by the slug that is its id.
A form is left out unless it holds an article or main element or more than half of the text.
The ratio of text to tags per line is smoothed with a Gaussian kernel, and a two-means threshold of its logarithm splits
lines into content and rest. Content weighs by its smoothed ratio times its length. The region is the article or main element with
the most content (of equal ones the first in the page), with its sibling articles, if these hold ARTICLE of the page's
content; in other pages the deepest element that holds REGION of the content, grown towards the root: at each parent
the blocks beside it join that are content by half of their text or have prose, lie between such blocks, or are headings
before them, but no boilerplate (most of its text is links, or a rights notice). Where that element is the body itself,
its blocks are chosen likewise. All lines of
the region are returned in page order: short paragraphs between long ones are not dropped. Where all lines have one
smoothed ratio all are content.

White space inside a block becomes one space (a <br> is white space), blocks are joined by a line feed, character
references are decoded. Null and empty html, and pages without text, give the empty string. Nothing is capped: a page
of any length is read whole, one page at a time. Rows that repeat, null ids and urls pass through; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Share of the content's smoothed mass that a region without article or main element has to hold.
REGION = 0.75
#: Share of the content's smoothed mass that an article or main element has to hold, with its sibling articles.
ARTICLE = 0.25
SIGMA = 1.5
#: A line is prose if it has so many letters outside links, or is a sentence.
PROSE = 80
SENTENCE = re.compile(r"\S+\s+\S+\s.*[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019)\]]*$", re.S)
RIGHTS = re.compile(r"^\W*(?:\u00a9|\(c\)|copyright\b)|\ball rights reserved\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
NEVER = frozenset(
    "script style noscript template head title nav footer aside iframe object svg math canvas audio video map select option textarea button input dialog menu".split()
)
#: An open element of the first kind ends when one of the second opens in the same block.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|sidebars?|side-?nav|menus?|nav|navbar|navigation|breadcrumbs?|comments?|"
    r"comment-?list|respond|repl(?:y|ies)|disqus|discussion|cookies?|consent|gdpr|notices?|alerts?|banners?|popups?|modals?|overlay|newsletters?|subscri(?:be|ption)|signup|login|"
    r"share|sharing|social|related|recommend(?:ed|ations)?|footers?|footer-\w+|site-?header|page-?header|masthead|header|topbar|toolbar|pagination|pager|widgets?|search|skip-?link|outbrain|taboola)(?:$|[\s_-])"
)
#: Inside articles only these whole words of a class, or of the id of what is no section, name boilerplate.
CLEAR = frozenset(
    "ad ads advert adverts advertisement advertisements advertising ad-slot ad-container ad-banner sponsored sponsor sponsors promo promos sidebar sidebars sidenav side-nav nav navbar navigation post-navigation "
    "breadcrumb breadcrumbs comments comments-area comments-section comment-list commentlist comment-form respond disqus disqus_thread cookie-notice cookie-banner cookie-consent "
    "newsletter newsletter-signup newsletter-form share sharing share-buttons share-links share-bar social-share social-sharing social-links social-icons social-buttons "
    "related-posts related-articles related-links related-stories recommended-posts recommended-articles footer entry-footer post-footer article-footer pagination pager toolbar widget widgets "
    "subscribe signup popup modal skip-link outbrain taboola".split()
)
#: Names of notices, adverts and comments, whose blocks inside articles go unless they hold much of it.
NOTES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|notices?|comments?|repl(?:y|ies)|respond)(?:$|[\s_-])")
#: Share of an article's other text that such a block may hold and still go.
NOTE = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN = re.compile(r"(?:^|\s)(?:articleBody|article-?body|post-?content|entry-?content|article-?content|main-?content)(?:$|\s)")


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, element number, left out
        self.out = 0  # open elements that are left out
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, tuple[int, ...], int]] = []  # text, tags before it, open blocks from the root 0, characters in links
        self.linked = 0
        self.made = 0
        self.kind: dict[int, bool] = {0: False}  # element -> whether it is an article or main element
        self.roots: set[int] = {0}  # the page, html and body
        self.headings: set[int] = set()
        self.links: set[int] = set()
        self.forms: set[int] = set()  # what they hold decides at the end of the page
        self.suspects: dict[int, bool] = {}  # blocks in articles with a name of boilerplate -> whether of a note

    def line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append((text, self.tags, (0, *(n for t, n, _ in self.stack if t in BLOCK)), self.linked))
                self.tags = 0
            self.linked = 0

    def named_out(self, tag: str, classes: str, name: str) -> bool:
        """Whether class and id name boilerplate. Headings never do; the id of a section is a slug of its heading."""
        if tag in HEADINGS or not BOILER.search(f"{classes} {name}"):
            return False
        words = set(classes.split())
        section = tag == "section" or "section" in words
        if any(self.kind[n] for _, n, _ in self.stack):
            if not CLEAR.isdisjoint(words if section else words | set(name.split())):
                return True
            if tag in BLOCK and not section:  # its text decides at the end of the page
                self.suspects[self.made + 1] = tag != "p" and bool(NOTES.search(f"{classes} {name}"))
            return False
        return not section or bool(BOILER.search(classes)) or name in CLEAR

    def pop_to(self, k: int) -> None:
        for _, _, left in self.stack[k:]:
            self.out -= left
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                if not self.out:
                    self.parts.append(" ")
            elif tag == "hr":
                self.line()
            return
        if tag in BLOCK:
            self.line()
            for k in range(len(self.stack) - 1, -1, -1):
                t = self.stack[k][0]
                if t in CLOSES and tag in CLOSES[t]:
                    self.pop_to(k)
                    break
                if t in BLOCK:
                    break
        left = tag in NEVER or tag == "header"
        main, form = tag in ("article", "main"), tag == "form"
        if attrs and not left:
            a = {k: v or "" for k, v in attrs}
            names = f"{a.get('class', '')} {a.get('id', '')}"
            role = a.get("role", "").lower()
            main = main or role in ("main", "article") or bool(MAIN.search(f"{names} {a.get('itemprop', '')}"))
            form = form or role == "form"
            left = "hidden" in a or a.get("aria-hidden") == "true" or role in ROLES and not (role == "alert" and any(self.kind[n] for _, n, _ in self.stack)) or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
            if not left and tag not in ("html", "body") and names != " " and not main and not form:
                left = self.named_out(tag, a.get("class", "").lower(), a.get("id", "").lower())
        elif tag == "header" and any(t == "article" for t, _, _ in self.stack):
            left = False  # an article's own heading
        self.made += 1
        self.kind[self.made] = main
        if tag in ("html", "body"):
            self.roots.add(self.made)
        if form:
            self.forms.add(self.made)
        if tag in HEADINGS:
            self.headings.add(self.made)
        elif tag == "a" and any(k == "href" for k, _ in attrs):
            self.links.add(self.made)
        self.stack.append((tag, self.made, left))
        self.out += left

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # browsers take <p/> as <p>
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in BLOCK:
                    self.line()
                self.pop_to(k)
                return
            if self.stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                break
        if tag in BLOCK:
            self.line()

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)
            if self.links and any(n in self.links for _, n, _ in self.stack):
                self.linked += len(" ".join(data.split()))


def without_forms(page: Page) -> list[tuple[str, int, tuple[int, ...], int]]:
    """The lines that lie in no form, but for forms that hold an article or main element or most of the text."""
    lines, forms = page.lines, page.forms
    if not forms:
        return lines
    whole = sum(len(t) for t, *_ in lines)
    size = dict.fromkeys(forms, 0)
    holds = set()
    for t, _, path, _ in lines:
        for k, n in enumerate(path):
            if n in forms:
                size[n] += len(t)
                if any(page.kind[x] for x in path[k:]):
                    holds.add(n)
    gone = {n for n in forms if n not in holds and 2 * size[n] <= whole}
    out, tags = [], 0
    for t, k, path, linked in lines:
        tags += k
        if gone.isdisjoint(path):
            out.append((t, tags, path, linked))
            tags = 0
    return out


def without_suspects(page: Page, lines: list) -> list[tuple[str, int, tuple[int, ...], int]]:
    """The lines but for blocks inside articles whose name and text both speak of boilerplate: most of it is links; or it has
    some links and half the article's text per tag at most; or it is a note of at most NOTE of the article's other text."""
    if page.suspects.keys().isdisjoint(n for *_, path, _ in lines for n in path):
        return lines
    sums: dict[int, list[int]] = {}  # characters, tags and characters in links of suspects and articles
    home: dict[int, int] = {}
    for t, tags, path, linked in lines:
        article = 0
        for n in path:
            if n in page.suspects:
                home[n] = article
            if n in page.suspects or page.kind[n]:
                article = n if page.kind[n] else article
                have = sums.setdefault(n, [0, 0, 0])
                for k, x in enumerate((len(t), max(1, tags), linked)):
                    have[k] += x
    gone = set()
    for n, at in home.items():
        (size, tags, linked), (whole, all_tags, _) = sums[n], sums[at]
        rest = whole - size
        thin = linked > 0 and 2 * size * max(1, all_tags - tags) < rest * tags
        if 2 * linked > size or thin or page.suspects[n] and size <= NOTE * rest:
            gone.add(n)
    return [line for line in lines if gone.isdisjoint(line[2])]


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over lines; at the ends the kernel is renormalised."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out, n = [], len(ratios)
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, ratios[lo:hi])) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Between the centres of two clusters of the values (two-means from the extremes)."""
    a, b = min(values), max(values)
    for _ in range(20):
        mid = (a + b) / 2
        low, high = [v for v in values if v <= mid], [v for v in values if v > mid]
        if not low or not high:
            return mid
        na, nb = sum(low) / len(low), sum(high) / len(high)
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    return (a + b) / 2


def clutter(some: list[tuple[str, int, tuple[int, ...], int]]) -> bool:
    """Whether most of a block's text is links, or all of it rights notices and links."""
    return 2 * sum(k for *_, k in some) > sum(len(t) for t, *_ in some) or all(2 * k > len(t) or RIGHTS.search(t) for t, _, _, k in some)


def mostly(some: list[tuple[str, int, tuple[int, ...], int]], content: list[bool]) -> bool:
    """Whether content lines hold at least half of a block's text."""
    return 2 * sum(len(line[0]) for line, c in zip(some, content) if c) >= sum(len(line[0]) for line in some)


def prose(line: tuple[str, int, tuple[int, ...], int]) -> bool:
    text, _, _, linked = line
    return 2 * linked <= len(text) and not RIGHTS.search(text) and (len(text) - linked >= PROSE or bool(SENTENCE.match(text)))


def children(lines, path: tuple[int, ...], at: int) -> list[list[int]]:
    """The lines below the element path[at], by its children in page order; a line of its own is a block."""
    blocks: dict[int, list[int]] = {}
    for i, (_, _, p, _) in enumerate(lines):
        if len(p) > at and p[at] == path[at]:
            blocks.setdefault(p[at + 1] if len(p) > at + 1 else -1 - i, []).append(i)
    return list(blocks.values())


def with_siblings(page: Page, lines, region: int) -> set[int]:
    """Lines of an article or main element and of the articles beside it (each alone in its wrappers, if any)."""
    keep = {i for i, line in enumerate(lines) if region in line[2]}
    path = lines[min(keep)][2]
    at = path.index(region)
    while at and sum(1 for _, _, p, _ in lines if len(p) >= at and p[at - 1] == path[at - 1]) == len(keep):
        at -= 1
    if at:
        for block in children(lines, path, at - 1):
            some = [lines[i] for i in block]
            shared = set(some[0][2][at:]).intersection(*(p for _, _, p, _ in some))
            if any(page.kind[n] for n in shared) and not clutter(some):
                keep.update(block)
    return keep


def grown(page: Page, lines, region: int, content: list[bool]) -> set[int]:
    """Lines of a region and of the blocks beside it and its ancestors that are no boilerplate. content: whether a line's
    smoothed ratio lies above the threshold."""
    keep = {i for i, line in enumerate(lines) if region in line[2]}
    path = lines[min(keep)][2]
    at = path.index(region)
    if region in page.roots and any(content[i] or prose(lines[i]) for i in keep):
        keep, at = set(), at + 1  # the article has no element of its own: its blocks are chosen too
    for at in range(at - 1, -1, -1):
        blocks = children(lines, path, at)
        inside = [not keep.isdisjoint(b) for b in blocks]
        bad = [not k and clutter([lines[i] for i in b]) for k, b in zip(inside, blocks)]
        good = [k or not x and (mostly([lines[i] for i in b], [content[i] for i in b]) or any(prose(lines[i]) for i in b)) for k, x, b in zip(inside, bad, blocks)]
        if not any(good):
            keep.update(i for b in blocks for i in b if content[i] or prose(lines[i]))
            continue
        first, last = good.index(True), len(good) - good[::-1].index(True)
        while first and not bad[first - 1] and all(not page.headings.isdisjoint(lines[i][2]) for i in blocks[first - 1]):
            first -= 1
        for k in range(first, last):
            if not bad[k] and not inside[k]:
                keep.update(blocks[k])
    return keep


def extract(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a marked section that the parser doesn't know
        page = Page()
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    page.line()
    lines = without_suspects(page, without_forms(page))
    if not lines:
        return ""
    dense = smoothed([len(t) / max(1, tags) for t, tags, *_ in lines])
    cut = math.expm1(threshold([math.log1p(d) for d in dense])) - 1e-9
    own = [d * len(line[0]) if d >= cut else 0.0 for line, d in zip(lines, dense)]
    whole = sum(own)
    mass: dict[int, float] = {}
    for (_, _, path, _), m in zip(lines, own):
        for n in path:
            mass[n] = mass.get(n, 0.0) + m
    named = [n for n in mass if page.kind[n]]
    # of nested elements with the same content the outer one, as page order has it first
    keep = with_siblings(page, lines, max(named, key=lambda n: (mass[n], -n))) if named else set()
    if not keep or sum(own[i] for i in keep) < ARTICLE * whole:
        region = max(n for n in mass if mass[n] >= REGION * whole)
        under = [p for _, _, p, _ in lines if region in p]
        if len(under) == 1 and under[0][-1] == region and region:
            # a region of one block: its parent holds the other blocks of the text
            region = under[0][-2]
        keep = grown(page, lines, region, [d >= cut for d in dense])
    return "\n".join(line[0] for i, line in enumerate(lines) if i in keep)


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html, ...)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for b in pieces(batches, "html"):
            text = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
