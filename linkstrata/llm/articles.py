"""Main text of evidence pages by the ratio of text to tag paths."""

from __future__ import annotations

import html
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from linkstrata.llm.common import snippet

# Names of HTML elements and of ARIA roles.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNREAD = frozenset("script style title textarea template noscript iframe svg object canvas audio video select datalist noframes xmp noembed button".split())
APART = frozenset("nav footer aside form menu dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)), "option": (("option",), ("select", "datalist")),
}
PARAGRAPH_BOUND = frozenset("html body article aside div section main td th li blockquote figure table ul ol dl details fieldset form header footer nav".split())
# Words in a class or id that name what is not part of an article.
APART_WORDS = frozenset(
    "ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars aside widget widgets footer masthead topbar toolbar comment comments commentlist disqus replies share sharing social related recommended "
    "recommendations teaser teasers pager pagination skip skiplink".split()
)
ARTICLE_WORDS = frozenset("article post entry story content".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)|([^>]*))>|<[!?/][^>]*>", re.S,
)
END_TAG = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in UNREAD}
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![^\s/])", re.I)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：؟،]")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

NEIGHBOURS = 5
LEAST_SHARE = 0.2
DEEPEST = 512  # elements below this depth count as their outer element, as in browsers


@dataclass(slots=True)
class Element:
    """A block element. One that only its class or id names apart counts as apart unless every article of the page is inside of it."""

    tag: str
    label: str
    number: int
    apart: bool
    named_apart: bool
    anchor: str  # "article", "main" or nothing
    anchors_inside: int = 0


@dataclass(slots=True)
class Block:
    elements: tuple[Element, ...]
    text: str
    link_chars: int


@dataclass(slots=True)
class PathSum:
    """Text nodes of one tag path."""

    labels: tuple[str, ...]
    nodes: int = 0
    chars: int = 0
    marks: int = 0


def _element(tag: str, attributes: str, number: int, in_article: bool) -> Element:
    found = {a.lower(): (b or c or d).strip() for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    anchor = next((a for a in ("article", "main") if a in (tag, role)), "")
    named = {w.lower() for key in ("class", "id") if key == "class" or tag not in HEADINGS for w in NAME_PART.findall(found.get(key, ""))}
    words = bool(named & APART_WORDS) or ("header" in named and not in_article and not named & ARTICLE_WORDS)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_STYLE.search(found.get("style", "")))
    apart = tag in APART or role in APART_ROLES or hidden or (tag == "header" and not in_article)
    words = words and tag not in ("html", "body") and anchor != "main"
    label = ".".join([tag, *sorted(found.get("class", "").lower().split())])
    return Element(tag, label, number, apart or (words and anchor == "article"), words, anchor)


def _inline_apart(tag: str, attributes: str) -> bool:
    element = _element(tag, attributes, 0, True)
    return element.apart or element.named_apart


def blocks_of(page: str) -> list[Block]:
    """Blocks of article text in page order with the block elements around them; what stands apart from the article is left out.

    Follows browsers where tags are left out: paragraphs, list items and table cells end where the next begins, stray end tags are ignored, the end of
    the page ends everything, and a tag that the end of the page cuts off is no text.
    """
    stack: list[Element] = []
    found: list[Block] = []
    text: list[str] = []
    muted: list[str] = []  # open inline elements from the first that stands apart
    anchors, number, link_chars, at, in_link = 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal link_chars, in_link
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                found.append(Block(tuple(stack), joined, link_chars))
            text.clear()
        muted.clear()
        link_chars, in_link = 0, False

    def close(tags, bound=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in bound:
                return

    while True:
        token = TOKEN.search(page, at)
        piece = page[at:token.start()] if token else CUT_TAG.sub("", page[at:])
        if piece and not muted:
            text.append(html.unescape(piece))
            link_chars += len(piece.strip()) if in_link else 0
        if not token:
            break
        at = token.end()
        tag, attributes = (token[2] or "").lower(), token[3] or token[4] or ""
        if tag in UNREAD and not token[1]:
            end = END_TAG[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag in BLOCKS:
            flush()
            if token[1]:
                close((tag,))
            elif tag != "hr":
                close(("p",), PARAGRAPH_BOUND)
                if tag in CLOSED_BY:
                    close(*CLOSED_BY[tag])
                if len(stack) >= DEEPEST:
                    continue
                number += 1
                element = _element(tag, attributes, number, any(e.anchor == "article" for e in stack))
                if element.anchor and not element.apart:
                    anchors += 1
                    for outer in stack:
                        outer.anchors_inside += 1
                stack.append(element)
        elif tag == "br":
            text.append(" ")
        elif tag and tag not in VOID:
            if token[1]:
                if tag in muted:
                    del muted[len(muted) - 1 - muted[::-1].index(tag):]
                in_link = in_link and tag != "a"
            else:
                if muted or (attributes and _inline_apart(tag, attributes)):
                    muted.append(tag)
                in_link = in_link or tag == "a"
    flush()
    return [b for b in found if not any(e.apart or (e.named_apart and not 0 < e.anchors_inside == anchors) for e in b.elements)]


def _distance(a: tuple, b: tuple) -> int:
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return len(a) + len(b) - 2 * shared


def content_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Tag paths whose ratios, smoothed and fused, reach the threshold.

    Per path: characters outside links and punctuation marks, each over the number of text nodes. Both are smoothed over the neighbouring paths in page order, nearer
    ones in the tree counting more, and fused as a geometric mean. Paths with at least LEAST_SHARE of the best are kept.
    """
    sums: dict[tuple[str, ...], PathSum] = {}
    for block in blocks:
        path = tuple(e.label for e in block.elements)
        held = sums.setdefault(path, PathSum(path))
        held.nodes += 1
        held.chars += max(0, len(block.text) - block.link_chars)
        held.marks += len(PUNCTUATION.findall(block.text))
    paths = list(sums.values())
    fused = []
    for i, here in enumerate(paths):
        near = paths[max(0, i - NEIGHBOURS):i + NEIGHBOURS + 1]
        weights = [2.0 ** -_distance(here.labels, p.labels) for p in near]
        whole = sum(weights)
        chars = sum(w * p.chars / p.nodes for w, p in zip(weights, near)) / whole
        marks = sum(w * p.marks / p.nodes for w, p in zip(weights, near)) / whole
        fused.append(math.sqrt(chars * (1 + marks)))
    least = LEAST_SHARE * max(fused, default=0.0)
    return {p.labels for p, score in zip(paths, fused) if score >= least and score > 0}


def _anchor(block: Block) -> Element | None:
    """The outermost article around a block, or else the outermost main element."""
    anchors = [e for e in block.elements if e.anchor]
    return next((e for e in anchors if e.anchor == "article"), anchors[0] if anchors else None)


def article_text(page: str) -> str:
    """Main text of one page: the blocks on content paths, and all others in the article, or else in the innermost common element, of these."""
    blocks = blocks_of(page)
    if any(map(_anchor, blocks)):
        blocks = [b for b in blocks if _anchor(b)]
    paths = content_paths(blocks)
    chosen = [b for b in blocks if tuple(e.label for e in b.elements) in paths]
    whole = {anchor.number for b in chosen if (anchor := _anchor(b))}
    if chosen and not whole:
        shared = os.path.commonprefix([[e.number for e in b.elements] for b in chosen])
        whole.update(e.number for e in chosen[0].elements[:len(shared)][-1:] if e.tag not in ("html", "body"))
    return "\n".join(b.text for b in blocks if tuple(e.label for e in b.elements) in paths or any(e.number in whole for e in b.elements))


def extract_articles(evidence: DataFrame) -> DataFrame:
    """Main text of every evidence page.

    Reads ``evidence_id``, ``url`` and ``snippet`` (the whole HTML). Returns ``evidence_id``, ``url``, ``snippet`` (the main text; empty if there is none) and ``n_chars``
    (its code points). Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by element, role, or words in class and id;
    of the rest, text length and punctuation are summed up per tag path from the root, smoothed, fused and held against a threshold (``content_paths``). Blocks that
    share the article element (or the innermost common element) of the chosen paths belong to the text too, however short. Character references are
    decoded, white space in a block becomes one space, blocks are joined by one line end.

    Pages are independent: a task reads its own rows, and nothing is shuffled. Null and empty pages have an empty text. Null ids and urls are kept. Repeated rows are
    extracted each. Pages of any length are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    kinds = [evidence.schema[c].dataType.simpleString() for c in ("evidence_id", "url")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["evidence_id", "url", "snippet", "n_chars"],
            )

    rows = evidence.select("evidence_id", "url", snippet().alias("snippet"))
    return rows.mapInArrow(extract, f"evidence_id {kinds[0]}, url {kinds[1]}, snippet string, n_chars bigint")
