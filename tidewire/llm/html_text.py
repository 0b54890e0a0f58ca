"""Main text of web pages by two-pass block rules.

One scan of the markup cuts a page into blocks at block-level tags and notes for every block the
containers it stands in, its words, and the words inside links. The first pass decides blocks that
are clear: blocks in menus, headers, footers, sidebars, notices, adverts, forms and comments (by
element, by a whole name in class, id or role, or by a name that begins or ends with the word for such
a container; a name that only holds such a word says nothing), blocks of mostly links, and long blocks with running text, which a share of stop words gives away.
A long block with hardly any stop words is no running text, unless the page or the block is in a
language without a list: then length and sentence signs decide. Short and unclear blocks stay open.
The second pass lets every open block inherit the label of its nearest decided neighbour within the
same container (article, main, or the rest of the page); a container without decided neighbours
counts as text if it is an article or main element, or if the page has neither. A block that the first
pass took out for its words alone stays if both neighbours are text.

The scan reads every character a bounded number of times, whatever the markup: a tag without an
end, a quote without a partner and an end tag without a start are noticed once, not searched again.

Defined cases: null, empty and unclosed markup give what text there is, or an empty string; a "<" that no
">" follows is text; a dropped element that is never closed ends where an article, main or h1 element
starts; a page that names alone would leave without any text is read again without them; only an attribute named hidden, or a style of display:none or visibility:hidden, hides an element; a
self-closing svg or math is empty; every block is taken whole, and a page of any length is one row
of one task; repeated rows are extracted one by one; empty tables give no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shingles import releasing, small_batches

STOP_WORDS = frozenset(
    # English
    "the of and to in is that it for was on as with be by at from this are or an have not but which".split()
    # German
    + "der die das und ist nicht mit den von zu ein eine auf für im dem des sich auch als".split()
    # French
    + "le la les de des du et est un une que qui dans pour par sur au avec pas ce".split()
    # Spanish
    + "el los las y en una por con para del se no su lo como más pero al es".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
# their content is never the article
DROP_TAGS = frozenset("nav header footer aside form head title noscript select button menu dialog fieldset textarea option template svg iframe object".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")  # all up to their end tag is no markup
FOREIGN = frozenset(("svg", "math"))  # may close themselves
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# whole names in class, id or role
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper "
    "banner banners sponsor sponsored promo promotion sidebar side-bar left-sidebar right-sidebar menu main-menu mobile-menu site-menu "
    "nav navbar nav-bar nav-menu main-nav site-nav top-nav navigation main-navigation site-navigation "
    "footer site-footer page-footer main-footer header site-header page-header main-header masthead topbar top-bar "
    "breadcrumb breadcrumbs cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices site-notice alert alerts "
    "popup modal overlay newsletter newsletter-signup subscribe signup sign-up login search-form share share-bar share-buttons sharing social-links social-share "
    "related related-articles related-links related-posts recommended "
    "comment comments comment-list commentlist comment-section comments-area comments-section disqus disqus_thread replies respond "
    "widget widgets toolbar pagination pager contentinfo complementary search dialog".split()
)
KEEP_TAGS = frozenset(("article", "main"))
# words for containers that a name of several parts may begin or end with
DROP_PARTS = frozenset("sidebar footer comments nav navbar menu newsletter breadcrumb breadcrumbs advert adverts advertisement".split())
COOKIE_PARTS = frozenset("notice bar banner consent law policy popup message wall info".split())
OPPOSITES = frozenset("with has no without".split())  # "content-with-sidebar" is no sidebar
KEEP_NAMES = frozenset("article main content post-content entry-content article-body post-body".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"""[>"']""")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
LINK = re.compile(r"<(/?)a(?=[\s>/])", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?…。！？।؟]")


def _container(name: str) -> bool:
    """Whether a class, id or role is the name of something that is no article."""
    if name in DROP_NAMES:
        return True
    parts = re.split("[-_]+", name)
    if len(parts) < 2 or OPPOSITES.intersection(parts):
        return False
    return parts[0] in DROP_PARTS or parts[-1] in DROP_PARTS or parts[0] in ("cookie", "cookies") and not COOKIE_PARTS.isdisjoint(parts) or parts[-1].isdigit() and parts[-2] in DROP_PARTS


def _drops(tag: str, attributes: str, inside: bool, names: bool) -> bool:
    """Whether an element is no part of an article; inside: it stands in one; names: class, id and role count."""
    if tag in DROP_TAGS and not (tag == "header" and inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape("".join(values))
        if name == "hidden" or name == "style" and HIDES.search(value):
            return True
        if names and name in ("class", "id", "role") and tag not in KEEP_TAGS:
            own = value.lower().split()
            if not KEEP_NAMES.intersection(own) and any(map(_container, own)):
                return True
    return False


def tokens_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, kind, tag, attributes) of all markup; kind is "raw", "start", "end" or "" for comments and the like."""
    at, quotes = 0, True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", "", ""
            continue
        slash = page.startswith("/", begin + 1)
        name = NAME.match(page, begin + 1 + slash)
        if not name and page[begin + 1 : begin + 2] not in ("!", "?", "/"):
            at = begin + 1  # a sign of the text
            continue
        tag = name.group().lower() if name else ""
        close, seek = -1, name.end() if name else begin + 1
        while name and quotes:
            found = STOP.search(page, seek)
            if not found:
                quotes = False  # all that is left of ">" stands in quotes, for this tag and for those after it
            elif found.group() == ">":
                close = found.start()
                break
            else:
                partner = page.find(found.group(), found.end())
                if partner < 0:
                    quotes = False
                seek = partner + 1
        if close < 0:
            close = page.find(">", begin)
            if close < 0:
                return  # no markup can end any more
        at = close + 1
        if not name:
            yield begin, at, "", "", ""
        elif slash:
            yield begin, at, "end", tag, ""
        elif tag in RAW:
            end = ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            yield begin, at, "raw", tag, ""
        else:
            yield begin, at, "start", tag, page[name.end() : close]


class Block:
    """A run of text between two block boundaries."""

    __slots__ = ("parts", "linked", "drop", "home", "label")

    def __init__(self, drop: bool, home: int):
        self.parts: list[str] = []
        self.linked = 0
        self.drop = drop
        self.home = home
        self.label: bool | None = None


def blocks_of(page: str, names: bool = True) -> tuple[list[tuple[str, Block]], dict[int, bool]]:
    """The non-empty blocks of a page with their text, and which containers are articles."""
    scanned = list(tokens_of(page))
    ended = Counter(tag for _, _, kind, tag, _ in scanned if kind == "end")
    stack: list[tuple[str, bool, int, bool]] = []  # element, dropped, container, never closed
    count: Counter[str] = Counter()
    homes = {0: False}
    found: list[Block] = []
    current = Block(False, 0)
    link = -1  # depth of the open link, if any
    wide = False  # it has an end, so it may hold blocks
    gone = -1  # depth of the outermost dropped element, if any

    def cut() -> None:
        nonlocal current
        if current.parts:
            found.append(current)
        drop, home = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        current = Block(drop, home)

    def text(s: str) -> None:
        if s:
            current.parts.append(s)
            if link >= 0:
                current.linked += len(s)

    def pop(size: int) -> None:
        nonlocal link, gone
        while len(stack) > size:
            count[stack.pop()[0]] -= 1
        if gone >= size:
            gone = -1
        if link > size:
            link = -1

    at = 0
    for begin, end, kind, tag, attributes in scanned:
        text(page[at:begin])
        at = end
        if kind == "raw":  # an element whose content is no text of the page
            cut()
        elif kind == "end":
            ended[tag] -= 1
            if tag == "a":
                link = -1
            elif count[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
                cut()
            elif tag in BLOCK_TAGS:
                cut()
        elif kind == "start" and tag == "a":
            after = LINK.search(page, end)
            link, wide = len(stack), bool(after and after.group(1))  # links do not nest
        elif kind == "start" and tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                cut()
        elif kind == "start" and not (tag in FOREIGN and attributes.endswith("/")):
            if tag in KEEP_TAGS or tag == "h1":
                # what was dropped and is never closed ends before an article
                if gone >= 0 and stack[gone][3]:
                    pop(gone)
            inside = bool(stack) and homes[stack[-1][2]]
            above = bool(stack and stack[-1][1])
            drop = above or _drops(tag, attributes, inside, names)
            if tag in BLOCK_TAGS or drop:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    pop(len(stack) - 1)
                home = stack[-1][2] if stack else 0
                if tag in KEEP_TAGS and not drop:
                    home = len(homes)
                    homes[home] = True
                # more starts are open than ends are to come
                never = drop and not above and count[tag] + 1 > ended[tag]
                if drop and not above:
                    gone = len(stack)
                stack.append((tag, drop, home, never))
                count[tag] += 1
                if not wide:
                    link = -1
                cut()
    text(page[at:])
    cut()
    out = []
    for b in found:
        whole = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
        if whole:
            out.append((whole, b))
    return out, homes


def _latin(text: str) -> bool:
    """Whether most letters are of the script that the stop words are written in."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" for c in letters) >= len(letters)


def classify(found: list[tuple[str, Block]], homes: dict[int, bool], long: int = 70, high: float = 0.15, low: float = 0.05, most_links: float = 0.5) -> None:
    """Both passes; sets every block's label to True for text and False for the rest."""
    density: dict[int, float] = {}
    for k, (whole, b) in enumerate(found):
        size = sum(map(len, b.parts))
        if b.drop or b.linked > most_links * size:
            b.label = False
        elif len(whole) >= long:
            words = [w.lower() for w in LETTERS.findall(whole)]
            density[k] = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    weak: set[int] = set()
    known = any(d >= high for d in density.values())  # some block is in a language that has a list
    for k, d in density.items():
        whole, b = found[k]
        if d >= high:
            b.label = True
        elif not known or not _latin(whole):
            b.label = True if SENTENCE.search(whole) else None
        elif d < low and not homes[b.home]:
            b.label = False
            weak.add(id(b))
    marked = any(homes.values())
    # second pass: nearest decided neighbour of the same container, by number of blocks
    by_home: dict[int, list[Block]] = {}
    for _, b in found:
        by_home.setdefault(b.home, []).append(b)
    for home, members in by_home.items():
        # what only lacks stop words, between two blocks of text, is one of them: a table, a line of names
        firm = [k for k, b in enumerate(members) if b.label is not None and not b.drop and id(b) not in weak]
        for left, right in zip(firm, firm[1:]):
            if members[left].label and members[right].label:
                for k in range(left + 1, right):
                    if id(members[k]) in weak:
                        members[k].label = True
        decided = [k for k, b in enumerate(members) if b.label is not None and not b.drop]
        labels = {k: members[k].label for k in decided}
        before, last = [], None
        for k in range(len(members)):
            last = k if k in labels else last
            before.append(last)
        after = None
        for k in range(len(members) - 1, -1, -1):
            after = k if k in labels else after
            if members[k].label is None:
                b = before[k]
                if b is None and after is None:
                    members[k].label = homes[home] or not marked
                elif b is None or (after is not None and after - k < k - b):
                    members[k].label = labels[after]
                elif after is None or k - b < after - k:
                    members[k].label = labels[b]
                else:  # equally near: text wins where the element says it is an article
                    members[k].label = labels[b] and labels[after] or (homes[home] and (labels[b] or labels[after]))


def main_text(page: str | None) -> str:
    """The article of one page."""
    for names in (True, False):
        found, homes = blocks_of(page or "", names)
        classify(found, homes)
        kept = [(whole, b) for whole, b in found if b.label]
        if kept or all(len(whole) < 70 for whole, _ in found):
            break
    inside = [whole for whole, b in kept if homes[b.home]]
    # where an article element holds text, text outside of it is no part of the article
    return " ".join(inside if inside else [whole for whole, _ in kept])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return small_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
