"""Main text of web pages by two passes over their blocks.

A page is cut into blocks: runs of text between block-level tags. What stands in a menu, header, footer, sidebar, form,
notice, advert or comment list by its element, role, class or id is set aside at once. The first pass classifies the
other blocks by length, link density and stop-word density. The second lets the blocks that are too short to tell
inherit the label of the nearest classified neighbour; crossing the border of an element counts as distance, and a
heading goes with what follows it. Where a page has an `article` (else a `main`, else an element named as content), only
its blocks are considered; its h1 is text, and so is what cannot be told there.

Nulls, empty pages and pages without text give an empty text. Broken markup is read as far as it goes: an unclosed
element ends with the one around it, and a tag cut off by the end of the page is dropped. Repeated rows stay repeated,
further columns are left out, whatever their names. Rows are independent of each other: a page is worked on where it is
read, no page is shuffled, and memory is bounded by an Arrow batch and by the longest page in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.common import map_batches

# --- fixed values: how HTML is read, and how pages name their parts ----------------------------------
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt "
                   "rtc s samp small span strike strong sub sup time tt u var wbr nobr blink".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav footer aside form button select option dialog menu head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar tablist".split())
STRONG_NAMES = frozenset("""comment comments commentlist commentary disqus respond replies discussion nav navbar navigation
menu menubar breadcrumb breadcrumbs footer colophon sidebar sidenav aside widget widgets ad ads adv advert adverts
advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner
popup modal overlay newsletter subscribe subscription signup login paywall related recommended recommendations trending
share sharing social tags toc pagination pager skip masthead topbar toolbar copyright disclaimer alert""".split())
PAGE_NAMES = frozenset("header head top".split())  # an article's own header is part of it
CONTENT_NAMES = frozenset("article articlebody articletext entry post postbody story content maintext main".split())
NEGATIONS = frozenset("has with no without".split())
STOP_WORDS = frozenset("""
the of and to is that it for with by this are in on as was be at or an from his her not have but they you which
le les des et une qui pour dans pas sur du au est il elle que se ce la en ne son avec par plus
der die das und nicht ist mit ein sich zu von den auf eine im dem auch es an werden aus er hat
el los las y una por con para como del al un lo su no si mas este son entre cuando
di il che e un per non sono da le si dei della o os um uma com
""".split())
# ------------------------------------------------------------------------------------------------------

SHORT, LONG = 70, 200  # characters: shorter cannot be told by its words, longer need fewer stop words
STOPS_LOW, STOPS_HIGH = 0.2, 0.3
LINKS = 0.5
BORDER = 3  # how many blocks the border of an element counts for

GOOD, BAD, UNSURE, OUT = 1, 0, -1, -2

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<other>[!?]|/(?=[^a-zA-Z>]))[^>]*+(?:>|\Z)"
                 r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)"
                 r"(?:>|(?P<cut>\Z))|/>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int      # characters of it inside links
    place: int       # position on the page, with borders counted
    section: int     # number of the article around it, 0 for none
    level: int       # 3 article, 2 main, 1 named as content, 0 none
    aside: bool      # set aside by the element it stands in
    heading: int     # 1 to 6, 0 for none
    label: int = UNSURE


def names_in(value: str) -> list[str]:
    return [n.lower() for n in NAMES.findall(value)]


def role_of(name: str, attrs: str, inside: int) -> tuple[bool, bool, int]:
    """(set aside, set aside for good, level as content) of an element, from its name and attributes."""
    aside = name in ASIDE or (name == "header" and not inside)
    strong = aside
    level = {"article": 3, "main": 2}.get(name, 0)
    if attrs and not attrs.isspace() and name not in ("html", "body"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
        role = found.get("role", "").lower()
        if role in ROLES or "hidden" in found or HIDDEN.search(found.get("style", "")) \
                or found.get("aria-hidden", "").lower() == "true":
            aside = strong = True
        words = names_in(found.get("class", "")) + names_in(found.get("id", ""))
        meant = [w for before, w in zip(["", *words], words) if before not in NEGATIONS]
        if not STRONG_NAMES.isdisjoint(meant) or (not inside and not PAGE_NAMES.isdisjoint(meant)):
            aside, strong = True, strong or bool({"comment", "comments", "commentlist", "respond", "related"} & set(meant))
        elif role == "main" or found.get("itemprop", "").lower() == "articlebody":
            level = max(level, 2)
        elif not CONTENT_NAMES.isdisjoint(meant):
            level = max(level, 1)
    return aside, strong, level


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in their order, not yet labelled but for what is set aside."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # (name, aside, for good, level, section) of every open element that is no inline one
    stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]
    links = sections = place = at = breaks = 0
    heading = 0

    def flush() -> None:
        nonlocal place, breaks
        breaks = 0
        if not pieces:
            return
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            _, aside, _, level, section = stack[-1]
            linked = sum(len(" ".join(p.split())) for p, inside in pieces if inside)
            place += 1
            out.append(Block(text, linked, place, section, level, aside, heading))
        pieces.clear()

    def say(raw: str) -> None:
        nonlocal breaks
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if breaks and not text.isspace():
                breaks = 0
            pieces.append((text, links > 0))

    while True:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        tag = TAG.match(page, start)
        if tag is None:  # a plain "<"
            say(page[at:start + 1])
            at = start + 1
            continue
        say(page[at:start])
        at = tag.end()
        if tag["name"] is None or tag["cut"] is not None:
            continue
        name, closing = tag["name"].lower(), bool(tag["end"])
        if name in RAW:
            if not closing and not tag["attrs"].endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = len(page) if shut is None else shut.end()
                rest = page.find(">", at)
                at = len(page) if rest < 0 else rest + 1
        elif name == "br":
            breaks += 1
            if breaks == 2:
                flush()
            else:
                pieces.append((" ", links > 0))
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
        elif name in VOID:
            if name == "hr":
                flush()
        elif closing:
            flush()
            links = 0
            if name in HEADINGS:
                heading = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if any(s[0] != "p" for s in stack[depth:]):
                        place += BORDER
                    del stack[depth:]
                    break
        else:
            flush()
            links = 0
            heading = int(name[1]) if name in HEADINGS else 0
            while stack[-1][0] == "p" or (stack[-1][0] in HEADINGS and name in HEADINGS) \
                    or (stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                stack.pop()  # what HTML lets stay open
            _, aside, strong, level, section = stack[-1]
            own_aside, own_strong, own_level = role_of(name, tag["attrs"], level)
            if own_level >= 2 and own_level > level and not own_aside and not strong:
                aside = False  # an article inside an element with a doubtful name
            if own_level > level and not own_aside:
                level = own_level
                sections += 1
                section = sections
            if name not in ("p", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead") and name not in HEADINGS:
                place += BORDER
            stack.append((name, aside or own_aside, strong or own_strong, level, section))
    flush()
    return out


def first_pass(block: Block) -> int:
    """What length, link density and stop words say of one block."""
    size = len(block.text)
    if block.level and block.heading == 1:
        return GOOD
    if block.linked > LINKS * size or (size < LONG and block.text.lower().startswith(("©", "(c) ", "copyright "))):
        return BAD
    if size < SHORT:
        return UNSURE
    words = WORD.findall(block.text.lower())
    latin = sum(w[0] < "ɐ" for w in words)
    if latin * 2 < len(words):  # no stop words are listed for other scripts: length decides
        return GOOD if size >= LONG // 4 else UNSURE
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH or (size >= LONG and stops >= STOPS_LOW):
        return GOOD
    return UNSURE if stops >= STOPS_LOW or block.level else BAD


def second_pass(blocks: list[Block], otherwise: int) -> None:
    """Unsure blocks take the label of the nearest sure neighbour, text where two are as near; `otherwise` where there
    is none."""
    before: list[tuple[int, int] | None] = []
    last = None
    for b in blocks:
        before.append(last)
        if b.label >= 0:
            last = (b.place, b.label)
    after = None
    labels = []
    for b, prev in zip(reversed(blocks), reversed(before)):
        if b.label >= 0:
            after = (b.place, b.label)
            labels.append(b.label)
        elif prev is None and after is None:
            labels.append(otherwise)
        elif after is not None and (b.heading or prev is None):
            labels.append(after[1])
        elif after is None:
            labels.append(prev[1])
        else:
            to_prev, to_next = b.place - prev[0], after[0] - b.place
            labels.append(max(prev[1], after[1]) if to_prev == to_next
                          else prev[1] if to_prev < to_next else after[1])
    for b, label in zip(reversed(blocks), labels):
        b.label = label


def labelled(page: str) -> list[Block]:
    """All blocks of a page with their final labels."""
    blocks = blocks_of(page)
    free = [b for b in blocks if not b.aside]
    level = max((b.level for b in free), default=0)
    scope = [b for b in free if b.level == level] if level else blocks
    for b in blocks:
        b.label = OUT
    for b in scope:
        b.label = OUT if b.aside else first_pass(b)
    if not level:  # what is set aside is a sure neighbour where nothing marks the text
        for b in scope:
            b.label = BAD if b.aside else b.label
        second_pass(scope, BAD)
    else:
        for section in {b.section for b in scope}:
            inside = [b for b in scope if b.section == section and not b.aside]
            if any(b.label == GOOD for b in inside):
                second_pass(inside, GOOD)
            else:
                for b in inside:
                    b.label = GOOD if b.label == UNSURE else b.label
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in labelled(page) if b.label == GOOD) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars, its code points, one row per row of `pages`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", "html")
    kinds = dict(kept.dtypes)
    return map_batches(kept, over, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
