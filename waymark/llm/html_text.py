"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block alone: text within menus, headers, footers, asides,
forms, scripts, styles, or elements whose class, id or role names such a thing, is bad; otherwise link density,
length and stop-word density make it good, bad, near good or short. Second pass, in context: near good and short
blocks inherit the label of the nearest decided neighbours.

A mark of the article (<article>, <main>, or a container named as its content) is evidence, weighed by density: it is
believed if at least half of the page's prose, as the first pass finds it, is inside, and else ignored. Where it is
believed, blocks outside are bad, and blocks inside that density would drop are ambiguous, so that they inherit from
the article's own blocks: nothing of the article's flow is lost. Inside an article, names that only hint at something
else (`related`, `legal`) make a block bad unless it is dense prose, and an id counts only on a box that is called nothing else. A
page without a mark on which no block is good (a language without known stop words, a list, one short paragraph) gives
all that is within an element, and neither named as something else nor mostly links.

Null or empty pages give ''. Repeated rows and ties are independent; other columns are ignored; pages are read whole, by a
scanner that only moves forward; broken markup is read as browsers do it roughly: unclosed elements end with their
parents, an unclosed comment or script lasts to the end, and after a quote that never closes a tag ends at the next '>'.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp|svg|object|select|canvas|audio|video"
BAD_TAGS = frozenset("nav aside footer form button dialog menu head".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist disqus cookie cookies consent gdpr notice notices alert "
    "popup modal newsletter subscribe subscription login signup toolbar pagination pager".split()
)
SOFT_NAMES = frozenset(
    "banner header masthead topbar reply replies respond overlay share sharing social related recommended recommendations widget widgets copyright legal "
    "disclaimer skip".split()
)
#: Inside an article an id names a box only if it has no other words: ids of headings and sections are made from their titles.
ID_NAMES = BAD_NAMES | SOFT_NAMES | frozenset("area bar block bottom box container form inline left list right section top wrap wrapper".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GOOD_NAMES = frozenset("article content post entry story main".split())
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "le la les de des du et à un une que qui dans en pour pas sur au avec ne se ce il est par plus sont son aux ou mais nous vous comme elle été "
    "el los las del y que en un una por con no para su se lo al más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, MOST_LINKS = 70, 200, 0.15, 0.30, 0.5

_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS.split("|")}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_SECTIONS = ("nav", "header", "footer", "aside", "menu")
_SECTION = re.compile(rf"<(/?)({'|'.join(_SECTIONS)})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Block:
    text: str
    bad: bool
    inside: bool
    soft: bool
    heading: bool
    link_density: float
    within: bool
    label: str = ""


@dataclass
class _Open:
    """An open element; bad, inside and soft hold for its parents too."""

    tag: str
    bad: bool = False
    inside: bool = False
    soft: bool = False


@dataclass
class _Page:
    """Blocks of a page while its tags are read."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    open: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    breaks: int = 0
    heading: bool = False

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append(raw)
            if not raw.isspace():
                self.breaks = 0
            if self.open["a"]:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        raw = "".join(self.pieces)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            o = self.stack[-1]
            self.blocks.append(Block(text, o.bad, o.inside and not o.bad, o.soft, self.heading, min(1.0, self.linked / len(text)), bool(o.tag)))
        self.pieces, self.linked, self.breaks, self.heading = [], 0, 0, False

    def close(self, at: int) -> None:
        self.open.subtract(o.tag for o in self.stack[at:])
        del self.stack[at:]

    def innermost(self, tags: set[str], scope: set[str] | frozenset[str]) -> int | None:
        """Place of the innermost open element among tags, unless one of scope is nearer."""
        if any(self.open[t] > 0 for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    return i
                if self.stack[i].tag in scope:
                    return None
        return None

    def start(self, tag: str, attributes: str, left_open: bool) -> None:
        if tag == "br":
            self.breaks += 1
            self.flush() if self.breaks > 1 else self.pieces.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
            if p := self.innermost({"p"}, BLOCK_TAGS):
                self.close(p)
            while tag in _CLOSES and (i := self.innermost(_CLOSES[tag], _SCOPES[tag])):
                self.close(i)
            if left_open:  # an article isn't part of a menu that was left open
                first = bisect(self.stack, False, key=lambda o: o.bad)
                sections = any(self.open[t] > 0 for t in _SECTIONS)
                if sections and (at := next((i for i in range(first, len(self.stack)) if self.stack[i].tag in _SECTIONS), None)):
                    self.close(at)
        if tag in VOID_TAGS:
            return
        names, role, up = set(), "", self.stack[-1]
        for kind, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if kind.lower() == "role":
                role = value.lower()
                continue
            told = {n.lower() for n in _NAME.findall(value)}
            if kind.lower() == "class" or not up.inside or tag == "div" and told <= ID_NAMES:
                names |= told
        if tag in ("html", "body", "main") or tag == "article" and not names & {"comment", "comments", "reply"}:
            named = hinted = False
        else:
            named, hinted = bool(names & BAD_NAMES), bool(names & SOFT_NAMES)
        bad = tag in BAD_TAGS or role in BAD_ROLES or named or not up.inside and (hinted or tag == "header")
        inside = not bad and (tag in ("article", "main") or tag in ("div", "section") and bool(names & GOOD_NAMES))
        self.stack.append(_Open(tag, up.bad or bad, up.inside or inside, up.soft or hinted and not names & GOOD_NAMES))
        self.open[tag] += 1
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = True

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            heading = self.heading
            self.flush()
            self.heading = heading and tag not in ("h1", "h2", "h3", "h4", "h5", "h6")
        if i := self.innermost({tag}, frozenset()):
            self.close(i)


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """The '>' that ends a tag, outside of quotes if these count; -1 if there is none."""
    if not quotes:
        return page.find(">", at)
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    state, at, done, quotes = _Page(), 0, 0, True
    sections = [(m.start(), m[2].lower(), bool(m[1])) for m in _SECTION.finditer(page)]
    places = [s[0] for s in sections]
    last, last_cdata = page.rfind(">"), page.rfind("]]>")
    while (i := page.find("<", at)) >= 0:
        if i > last and not page.startswith("<!--", i):  # no tag ends from here on
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            tag = None
        elif page.startswith(("<!", "<?"), i):
            cdata = i < last_cdata and page.startswith("<![CDATA[", i)
            end, tag = page.find("]]>", i) + 3 if cdata else page.find(">", i) + 1, None
        elif tag := _TAG.match(page, i):
            end = _tag_end(page, tag.end(), quotes) + 1
            if not end and quotes:
                quotes = False
                end = _tag_end(page, tag.end(), quotes) + 1
        else:
            end = 0
        if not end:  # a sign, not a tag
            at = i + 1
            continue
        state.text(page[done:i])
        at = done = end
        if tag is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            state.end(name)
        elif name in _RAW_END and page[end - 2] != "/":
            close = _RAW_END[name].search(page, end)
            at = done = close.end() if close else len(page)
            if name in BLOCK_TAGS:
                state.flush()
        else:
            following = sections[k] if (k := bisect(places, i)) < len(sections) else None
            left_open = name == "main" or name == "article" and not (following and following[2] and state.open[following[1]] > 0)
            state.start(name, page[tag.end() : end - 1], left_open)
    state.text(page[done:])
    state.flush()
    return state.blocks


def by_density(b: Block) -> str:
    """First pass: what a block's links, length and stop words say of it."""
    if b.bad or b.link_density > MOST_LINKS or b.text.startswith("\N{COPYRIGHT SIGN}"):
        return "bad"
    if len(b.text) < LENGTH_LOW:
        return "short" if not b.link_density else "bad"
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    return "bad" if stops < STOP_LOW else "good" if stops >= STOP_HIGH and len(b.text) > LENGTH_HIGH else "near"


def _nearest(labels: list[str], at: range) -> dict[int, int]:
    """For each place, the last decided one before it in the order of `at`."""
    out, last = {}, None
    for i in at:
        if last is not None:
            out[i] = last
        if labels[i] in ("good", "bad"):
            last = i
    return out


def by_neighbours(found: list[Block], default: str | None = None) -> None:
    """Second pass: near good and short blocks take the label of the nearest decided ones, or the default without any."""
    labels = [b.label for b in found]
    before, after = _nearest(labels, range(len(found))), _nearest(labels, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if labels[i] in ("short", "near"):
            near = [(abs(j - i), labels[j] != "good", labels[j]) for j in (before.get(i), after.get(i)) if j is not None]
            both = {n[2] for n in near}
            if len(both) == 2 and (labels[i] == "near" or b.heading and labels[after[i]] == "good"):
                b.label = "good"
            else:
                b.label = min(near)[2] if near else default or ("good" if labels[i] == "near" else "bad")


def classify(found: list[Block]) -> None:
    """Both passes; every block ends as good or bad."""
    prose = Counter()
    for b in found:
        b.label = by_density(b)
        if b.label in ("good", "near"):
            prose[b.inside] += len(b.text)
        if b.soft and b.label != "good":
            b.label, b.bad = "bad", True
    own = [b for b in found if b.inside and not b.bad]
    if not any(b.inside for b in found) and not any(b.label == "good" for b in found):
        for b in found:  # nothing is marked and nothing is dense in words that are known: what is neither named nor linked is the text
            b.label = "bad" if b.bad or not b.within or b.link_density > MOST_LINKS or b.text.startswith("\N{COPYRIGHT SIGN}") else "good"
        return None
    if not any(b.inside for b in found) or prose[True] < prose[False]:
        return by_neighbours(found)
    for b in found:
        if not b.inside:
            b.label = "bad"
    for b in own:
        if b.label == "bad":
            b.label = "short" if len(b.text) < LENGTH_LOW else "near"
    by_neighbours(own, "good")


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; a narrow stage without any shuffle."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
