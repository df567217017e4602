"""HTML to blocks of text with the regions they stand in. Pure functions, no Spark."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold article text.
_NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noframes noscript object option script search select style svg template textarea title video".split())
#: Words of class, id or role names that mark something other than the article.
_OTHER = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond responses search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar toc tracking widget widgets".split()
)
#: The same, but only outside an article (an article may have a header of its own).
_OUTSIDE = frozenset("header head top bar bottom".split())
_MAIN = frozenset("articlebody".split())
_CONTENT = frozenset("article articlebody body content entry main maincontent post story text".split())
_CONTENT_LEAD = frozenset("article content entry main post story".split())
#: An opening tag that closes open elements of these names, and where the search stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

ARTICLE, MAIN, CONTENT, PLAIN, OTHER = 4, 3, 2, 1, 0

#: Kinds of structured blocks: boilerplate by its mark-up, a line of a page that marks no
#: article region, a line of the article region, a line outside it.
BOILERPLATE, LINE, INSIDE, OUTSIDE = 0, 1, 2, 3


class Block(NamedTuple):
    text: str
    #: The strongest region it stands in; OTHER if anything around it is not article.
    region: int
    #: Name and marks of the outermost element that makes it OTHER.
    slot: str = ""


class Piece(NamedTuple):
    """A structured block: one block of text, or all that a menu, an advert or the like holds."""

    #: A digest in all bits but the last two, which hold the kind.
    key: int
    texts: list[str]


def _region(name: str, attrs: str, above: int) -> int:
    """Region of an element from its name and attributes, inside a region."""
    if above == OTHER or name in _NEVER or (name == "header" and above < CONTENT):
        return OTHER
    found = above
    if attrs and not attrs.isspace():
        marks: list[str] = []
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return OTHER
            marks += value.split() if key not in ("hidden", "aria-hidden") else []
        for mark in marks:
            words = _WORD.findall(_CAMEL.sub(" ", mark).lower())
            if name not in ("html", "body", "main") and (_OTHER.intersection(words) or above < CONTENT and _OUTSIDE.intersection(words)):
                return OTHER
            if words and (words[0] in _CONTENT_LEAD or "".join(words) in _MAIN) and _CONTENT.issuperset(words[-1:]) and name != "body":
                found = max(found, CONTENT)
            if mark.lower() == "main":
                found = max(found, MAIN)
    if name == "article":
        return ARTICLE
    return max(found, MAIN) if name == "main" else found


def _slot(name: str, attrs: str) -> str:
    """What tells an element from others of its name on every page of a site: its marks without numbers."""
    marks = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]
    return " ".join([name, *sorted({w for key, value in marks if key in ("class", "id", "role") for w in _WORD.findall(value.lower())})])


def blocks(page: str) -> Iterator[Block]:
    """Blocks of a page in order: references decoded, white space joined, empty ones left out."""
    stack: list[tuple[str, int, str]] = []
    region, slot, parts, at = PLAIN, "", [], 0

    def close() -> Iterator[Block]:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield Block(text, region, slot)

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            yield from close()
        elif name == "br":
            parts.append(" ")
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                after = stack[depth - 1][1:] if depth else (PLAIN, "")
                if after != (region, slot):
                    yield from close()
                del stack[depth:]
                region, slot = after
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            tail = page.find(">", stop.start()) if stop else -1
            at = tail + 1 if tail >= 0 else len(page)
            continue
        shut, bound = ({"p"}, {"table", "article", "section", "div", "li", "td"}) if name in _BLOCK and name not in _CLOSES else _CLOSES.get(name, ((), ()))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in shut:
                region, slot = stack[i - 1][1:] if i else (PLAIN, "")
                del stack[i:]
                break
            if stack[i][0] in bound:
                break
        if name in _VOID:
            continue
        inside = _region(name, m["attrs"], region)
        if inside != region:
            yield from close()
            slot = _slot(name, m["attrs"]) if inside == OTHER else ""
        stack.append((name, inside, slot))
        region = inside
    yield from close()


def _lengths(mine: list, other: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``mine`` with every beginning of ``other``."""
    where: dict = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = row = (1 << len(other)) - 1
    for x in mine:  # one row of the dynamic programme, a bit for each column
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def shared_lines(mine: list, other: list) -> set[int]:
    """Indexes of ``mine`` that a longest common subsequence with ``other`` holds.

    Divide and conquer: the first half of ``mine`` goes with the beginning of ``other``
    that gives the longest subsequence in all, so memory grows with the lines, not with
    their product.
    """
    common = set(mine) & set(other)
    found: set[int] = set()
    todo = [([i for i, x in enumerate(mine) if x in common], [x for x in other if x in common])]
    while todo:
        a, b = todo.pop()
        most = min(len(a), len(b))
        head = next((i for i in range(most) if mine[a[i]] != b[i]), most)
        tail = next((i for i in range(most - head) if mine[a[-1 - i]] != b[-1 - i]), most - head)
        found.update(a[:head], a[len(a) - tail :])
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not a or not b:
            continue
        if len(a) == 1:
            found |= {a[0]} if mine[a[0]] in b else set()
            continue
        half = len(a) // 2
        before = _lengths([mine[i] for i in a[:half]], b)
        after = _lengths([mine[i] for i in reversed(a[half:])], b[::-1])
        cut = int((before + after[::-1]).argmax())
        todo += [(a[:half], b[:cut]), (a[half:], b[cut:])]
    return found


def article_lines(page: list[Block]) -> tuple[list[str], bool]:
    """Lines of the strongest article region, and whether the page marks no such region."""
    best = max((b.region for b in page), default=OTHER)
    return [b.text for b in page if b.region == best and best != OTHER], best == PLAIN


def _digest(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & -4) - (1 << 63)


def pieces(page: list[Block]) -> list[Piece]:
    """Structured blocks of a page.

    The words of a menu or an advert change from page to page, so it is known by its slot;
    blocks of one slot that follow each other are one piece, however many they are. Other
    blocks are known by their text.
    """
    best = max((b.region for b in page), default=OTHER)
    out: list[Piece] = []
    for b in page:
        if b.region == OTHER:
            key = _digest("\n" + b.slot) | BOILERPLATE  # no block holds a line feed
            if out and out[-1].key == key:
                out[-1].texts.append(b.text)
                continue
        else:
            key = _digest(b.text) | (LINE if best == PLAIN else INSIDE if b.region == best else OUTSIDE)
        out.append(Piece(key, [b.text]))
    return out


def template_pieces(mine: list[int], near: list[int]) -> set[int]:
    """Indexes of the keys that a page shares with its nearest page: aligned ones, and boilerplate in another place."""
    ids = [k >> 2 for k in near]
    held = set(ids)
    return shared_lines([k >> 2 for k in mine], ids) | {i for i, k in enumerate(mine) if k & 3 == BOILERPLATE and k >> 2 in held}


def deleted_pieces(mine: list[int], near: list[int] | None) -> set[int]:
    """Indexes of the pieces that a page loses, by its keys and those of its nearest page.

    What the two share is template and goes. A check by mark-up follows:

    * lines inside a marked article region come back, since articles share lines too;
    * lines outside it go;
    * boilerplate that the nearest page has no slot for never repeats there, so the mark-up
      alone tells it, and it goes;
    * the lines of a page that marks no region come back if all of them are shared: that
      tells nothing.
    """
    shared = template_pieces(mine, near) if near is not None else set()
    known = {k >> 2 for k in near or ()}
    back = {i for i in shared if mine[i] & 3 == INSIDE}
    lines = {i for i, k in enumerate(mine) if k & 3 == LINE}
    if lines <= shared:
        back |= lines
    alone = {i for i, k in enumerate(mine) if k & 3 == OUTSIDE or k & 3 == BOILERPLATE and k >> 2 not in known}
    return shared - back | alone
