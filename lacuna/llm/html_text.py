"""Main text of HTML pages by two-pass block rules.

A page is read once, tag by tag, into blocks: runs of text between block-level tags. The first pass decides
blocks by link density, stop-word density and length: blocks of links and long blocks without stop words are out, long
enough ones with stop words are text, and blocks too short to tell stay ambiguous. In the second pass each ambiguous
block takes the label of the nearest decided block of its region (of two equally near ones, text counts); a
heading looks at what follows it first.

Markup is one feature of the rules, as where a block stands:

* in an element of page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments; known by
  element, role or visibility, or by class or id) it is decided at once;
* in a region that the page marks as its content (article, main, or a content class), which drops nothing else, what
  would count against it leaves it ambiguous, so links and tables of an article stay;
* outside such a region, where the page has one with at least as much text, it is not text.

A class or id does not make furniture of an element that holds the page's largest content region (if it is as long as the
prose outside), nor, on pages without such a region, nearly all of its text: ``page-has-sidebar`` is a layout and not a sidebar. Broken markup is read as
browsers read it: unclosed elements end with their parents, a tag that breaks off at the end of the page is
no text, and a stray "<" is.

Defined results: null or empty html gives an empty text; a page without text too. Where no block can be decided to be text,
as on a page of a few words, ambiguous blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import IntEnum

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried

#: Thresholds of the first pass, in characters and shares.
SHORT_CHARS, LONG_CHARS, STOP_HIGH, STOP_LOW, STOP_NONE, LINKS_HIGH, SENTENCE_CHARS = 90, 200, 0.20, 0.10, 0.05, 0.5, 400

#: The share of a page's text above which an element is its layout, whatever its class says.
LAYOUT_SHARE = 0.9

# Element names by role (HTML standard).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "select")
FURNITURE_TAGS = frozenset("nav footer aside form head title menu dialog button".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip status".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar sidenav menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations popup modal overlay widget widgets pagination pager skip toolbar copyright "
    "disclaimer paywall taboola outbrain alert".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond related recommended teaser sponsored ad advert".split())
#: Furniture words that count in an article together with words of layout; others count there alone, or where the text agrees.
INSET_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion comment comments commentlist disqus respond reply replies related recommended recommendations "
    "teaser cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay paywall taboola outbrain notification disclaimer".split()
)
LAYOUT_WORDS = frozenset(
    "list box section area container wrapper wrap block inner outer item items form thread bar link links post posts article articles story stories count button buttons row col column top bottom left right "
    "header title site page user reader readers google slot unit holder zone placeholder panel body text content main global primary secondary mobile desktop sticky fixed inline".split()
)
CONTENT_NAMES = frozenset("content post entry story article articlebody article-body article-content entry-content post-content post-body story-body main-content maincontent content-main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How a note of rights begins.
RIGHTS = ("©", "(c) ", "copyright ")
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their there they this to was we were which will with you "
    "aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y à "
    "al como con de del donde el ella en entre es esta este fue ha han la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya".split()
)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>(?:.*?</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
#: The end of a sentence, in scripts with and without spaces; and the characters of scripts that say in one what others say in three.
_SENTENCE = re.compile(r"[.!?…।؟۔][\"'”’»)\]]*(?=\s|$)|[。！？]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


class Place(IntEnum):
    """What the markup says of a block."""

    PLAIN = 0
    CONTENT = 1
    OUTSIDE = 2
    FURNITURE = 3


@dataclass
class Block:
    """A run of text between block-level tags, and where it stands."""

    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    region: int = 0  # the outermost content element around it; 0 outside
    furniture: bool = False  # by element, role or visibility
    doubtful: tuple[int, ...] = ()  # elements around it whose class or id speaks of furniture
    heading: bool = False
    text: str = ""
    place: Place = Place.PLAIN


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source and not source.isspace() else {}


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def is_furniture(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    """Whether an element holds page furniture, by its name, role or visibility."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_content):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("article", "main") and any(re.split(r"[-_:]+", name)[0] in COMMENT_WORDS for name in _names(attributes)):
        return True
    return attributes.get("role", "").lower() in FURNITURE_ROLES


def doubt(tag: str, attributes: dict[str, str], in_content: bool) -> int:
    """Whether an element's class or id speaks of furniture: 2 where it does, 1 where it may be an article's own subject, 0 where not.

    In an article a name is furniture if all its parts are furniture words, or if it is made of an advert's or comment's words and of words of layout.
    Another name with a furniture word ("social-history") leaves it to the text.
    """
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name in _names(attributes):
        parts = re.split(r"[-_:]+", name)
        if parts[0] in ("has", "with", "no", "is", "without"):
            continue
        if parts in (["header"], ["site", "header"], ["page", "header"]) and not in_content:
            return 2
        if FURNITURE_WORDS.isdisjoint(parts):
            continue
        rest = [x for x in parts if x and not x.isdigit() and x not in FURNITURE_WORDS]
        if not in_content or not rest or (LAYOUT_WORDS.issuperset(rest) and not INSET_WORDS.isdisjoint(parts)):
            return 2
        found = 1
    return found


def is_content(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody" or not CONTENT_NAMES.isdisjoint(_names(attributes))


def read_blocks(page: str) -> list[Block]:
    """The page's blocks in page order, with text decoded and white space as one space, and their places."""
    blocks: list[Block] = []
    block = Block()
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, furniture, doubtful, content
    furniture = content = links = headings = elements = region = 0
    doubtful: list[int] = []
    weak: set[int] = set()  # doubtful elements whose text decides
    around: dict[int, tuple[int, ...]] = {}  # of each content region, the doubtful elements around it

    def finish() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                blocks.append(block)
        block = Block()

    def text(piece: str) -> None:
        if piece:
            decoded = html.unescape(piece) if "&" in piece else piece
            if block.parts and block.furniture != (furniture > 0):  # an inline element of furniture begins or ends
                finish()
            if not block.parts:
                block.region, block.furniture, block.doubtful, block.heading = region if content else 0, furniture > 0, tuple(doubtful), headings > 0
            block.parts.append(decoded)
            if links:
                block.link_chars += len("".join(decoded.split()))

    def close(k: int) -> None:
        nonlocal furniture, content, links, headings
        while len(stack) > k:
            name, was_furniture, was_doubtful, was_content = stack.pop()
            furniture -= was_furniture
            content -= was_content
            links -= name == "a"
            headings -= name in HEADINGS
            if was_doubtful:
                doubtful.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if (m["raw"] or "").lower() in ("svg", "canvas", "iframe", "object", "audio", "video"):
                text(" ")
            continue
        if tag in BLOCK_TAGS:
            finish()
        elif tag == "br":
            text(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main", "section", "div"):
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if tag in ("p", "li", "td", "th", "tr", "option", "dd", "dt", "a"):  # these end their predecessor
            until = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dd": ("dl",), "dt": ("dl",)}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in until or (stack[k][0] in BLOCK_TAGS and tag not in ("td", "th", "tr", "li")):
                    break
        elif tag == "body":  # a head that was not closed
            close(next((k for k, x in enumerate(stack) if x[0] == "head"), len(stack)))
        attributes = _attributes(m["attrs"])
        out = is_furniture(tag, attributes, content > 0)
        found = not furniture and not out and is_content(tag, attributes)
        doubts = 0 if out or (found and not content) else doubt(tag, attributes, content > 0)
        if found and not content:
            region += 1
            around[region] = tuple(doubtful)
        if doubts:
            elements += 1
            doubtful.append(elements)
            if doubts == 1:
                weak.add(elements)
        stack.append((tag, out, doubts > 0, found))
        furniture += out
        content += found
        links += tag == "a"
        headings += tag in HEADINGS
    text(page[at:])
    finish()
    _acquit(blocks, weak)
    _place(blocks, around)
    return blocks


def _acquit(blocks: list[Block], weak: set[int]) -> None:
    """Clear elements that their names alone make doubtful, if at least half of their text is prose."""
    chars: Counter[int] = Counter()
    for b in blocks:
        for e in weak.intersection(b.doubtful) if weak and not b.furniture else ():
            chars[e] += len(b.text) * (1 if is_prose(b) else -1)
    cleared = {e for e, n in chars.items() if n >= 0}
    for b in blocks if cleared else ():
        b.doubtful = tuple(e for e in b.doubtful if e not in cleared)


def _place(blocks: list[Block], around: dict[int, tuple[int, ...]]) -> None:
    """Give each block its place, when the whole page is known."""
    chars: Counter[int] = Counter()
    for b in blocks:
        if b.region and not b.furniture and len(b.doubtful) == len(around[b.region]):
            chars[b.region] += len(b.text)
    prose = sum(len(b.text) for b in blocks if not (b.region or b.furniture or b.doubtful) and first_pass(b)) if chars else 0
    largest = max(chars, key=lambda r: (chars[r], -r), default=0)
    if largest and chars[largest] >= prose:
        layout = set(around[largest])
    else:
        shares: Counter[int] = Counter()
        for b in blocks:
            if not b.furniture and first_pass(b):
                shares.update(dict.fromkeys((0, *b.doubtful), len(b.text)))
        layout = {e for e, n in shares.items() if e and n >= LAYOUT_SHARE * shares[0]}
    for b in blocks:
        if b.furniture or not layout.issuperset(b.doubtful):
            b.place = Place.FURNITURE
    inside = sum(len(b.text) for b in blocks if b.region and b.place == Place.PLAIN)
    beside = sum(len(b.text) for b in blocks if not b.region and b.place == Place.PLAIN and first_pass(b)) if inside else 0
    for b in blocks:
        if b.place == Place.PLAIN:
            b.place = Place.CONTENT if b.region else Place.OUTSIDE if inside and inside >= beside else Place.PLAIN


def is_rights(block: Block) -> bool:
    return block.text[:10].lower().startswith(RIGHTS)


def _size(text: str) -> int:
    """Characters; those of dense scripts count three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _linked(block: Block) -> bool:
    return block.link_chars > LINKS_HIGH * len(block.text.replace(" ", ""))


def _in_sentences(text: str) -> bool:
    """Whether a text has ends of sentences, one at least in every ``SENTENCE_CHARS`` characters."""
    return len(_SENTENCE.findall(text)) * SENTENCE_CHARS >= _size(text)


def is_prose(block: Block) -> bool:
    """Whether a block reads as text by itself, in any language."""
    return not _linked(block) and _size(block.text) >= SHORT_CHARS and (_stops(block.text) >= STOP_LOW or _in_sentences(block.text))


def first_pass(block: Block) -> bool | None:
    """True for text, False for furniture, None where the block is too short or too odd to tell.

    A long block with few stop words may be of a language whose stop words are not known: it is text if it has sentences.
    """
    if block.place in (Place.FURNITURE, Place.OUTSIDE):
        return False
    content, chars = block.place == Place.CONTENT, _size(block.text)
    if _linked(block) or is_rights(block):
        return None if content else False
    if chars < SHORT_CHARS:
        return None
    stops = _stops(block.text)
    if stops >= (STOP_LOW if chars >= LONG_CHARS or content else STOP_HIGH):
        return True
    if chars >= LONG_CHARS and stops < STOP_NONE and _in_sentences(block.text):
        return True
    return None if content or chars < LONG_CHARS or stops >= STOP_NONE else False


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided block of their region, or are text if it has none.

    A note of rights is decided for itself alone: it stands right below a text as well as elsewhere.
    """
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    regions = [b.region if b.place == Place.CONTENT else 0 for b in blocks]
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for k in order:
            out[k] = last.get(regions[k])
            if labels[k] is not None and not is_rights(blocks[k]):
                last[regions[k]] = k
    some, decided = any(labels), []
    for k in range(n):
        if labels[k] is not None:
            decided.append(labels[k])
            continue
        near = [x for x in (before[k], after[k]) if x is not None]
        if blocks[k].heading and after[k] is not None:
            near = [after[k]]
        least = min((abs(x - k) for x in near), default=0)
        decided.append(any(labels[x] for x in near if abs(x - k) == least) if near and some else True)
    return decided


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks of text in page order, joined by line feeds."""
    blocks = read_blocks(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, second_pass(blocks, [first_pass(b) for b in blocks]), strict=True) if keep)


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """A row per row of ``df``: the id columns, ``text`` and ``n_chars`` (its code points)."""
    carried = [Carried(df, c, f"id{k}") for k, c in enumerate(id_cols)]
    schema = ", ".join(f"id{k} {c.kind}" for k, c in enumerate(carried))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield batch.drop(columns="html").assign(text=texts, n_chars=[len(x) for x in texts])

    narrow = df.select(*[c.sent for c in carried], F.col(html_col).alias("html"))
    out = narrow.mapInPandas(extracted, f"{schema}, text string, n_chars long")
    return out.select(*[c.back for c in carried], "text", "n_chars")
