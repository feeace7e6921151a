"""Main text of web pages by block rules in two passes.

A page is read as blocks of text with the share of it in links and the share of
its words that are stop words. The first pass judges a block by itself: links
make it boilerplate, length and stop words make it content, and a short block is
left open (the rules known as jusText: Pomikálek, "Removing Boilerplate and
Duplicate Content from Web Corpora", 2011). The second pass gives each open block
the label of its nearest decided neighbours.

Markup narrows the choice before the text is judged. What stands in a navigation,
header, footer, aside, form or the like, by element, role, or a word of its class
or id, is boilerplate. A page's article elements, or else its main element, bound
its content: blocks outside are boilerplate, and inside a block counts as open
until its links say otherwise. A form, or a word of a class or id, is weak evidence:
where such a wrapper holds the article or main element of a page that has none
outside, and most of its text, the wrapper is no reason; and where nothing outside
is content, the passes judge what such wrappers hold. Comments stay out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import extended, slices, texts

# Characters from which a block is long enough to be judged, and to be content.
SHORT, LONG = 70, 200
# Shares of words that are stop words: below the first a block reads like a list,
# from the second on it reads like prose.
FEW_STOPS, MANY_STOPS = 0.10, 0.25
MOST_LINKED = 0.5  # share of characters in links

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she that the their
there they this to was we were what when which who will with would you
aber als am auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für haben hat
ich ihr im ist kann mit nach nicht noch nur oder sich sie sind so über um und uns unter von vor war wenn wie wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il je la le les leur mais ne nous on ont ou par pas plus pour
qu que qui sa se ses son sont sur un une vous
al como con del el ella ellos era esta este ha la las lo los más muy no nos para pero por porque se sin sobre su sus también
una uno y ya
""".split())

# Elements whose content is no markup, up to their own end tag.
_RAW = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in "script style textarea title xmp iframe noembed noframes".split()
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike
strong sub sup time tt u var wbr img
""".split())
_EXCLUDED = frozenset("""
head nav footer aside form noscript template svg math button select option datalist dialog menu object audio video canvas
map applet script style textarea title iframe
""".split())
# An element that the next one of these names ends when it is left open.
_ENDS = {
    "p": frozenset("p"), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]), "body": frozenset(["head"]),
}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_WORDS = frozenset("""
ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promoted banner
nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar
header masthead footer colophon copyright sidebar sidebars aside rail widget widgets
related recommended recommendations share sharing social
comment comments commentlist respond disqus replies
cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay
newsletter subscribe subscription signup login signin register search searchbox form paywall skip
""".split())
_REMARKS = frozenset("comment comments commentlist respond disqus replies".split())
_OWN = frozenset("article post entry story content main page text body".split())  # such a header or text is the content's
_NEUTRAL = frozenset("with has have no without is not".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    inside: int  # 1 in an article, 2 in main, 0 elsewhere; WRAPPED more for those in a doubtful wrapper
    out: int  # how surely markup excludes it: NOT, MAYBE or SURELY
    heading: bool


NOT, MAYBE, SURELY = 0, 1, 2
WRAPPED = 2


def _excluded(name: str, attrs: str, within: int) -> int:
    """How surely markup says that an element is no main text."""
    if name in _EXCLUDED and name != "form":
        return SURELY
    if name == "header" and within < 1:
        return SURELY
    doubt = MAYBE if name == "form" else NOT
    if not attrs or name in ("header", "html", "body", "main"):
        return doubt
    for match in _ATTRIBUTE.finditer(attrs):
        key = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURELY
        if key == "role" and value.lower() in _ROLES:
            return SURELY
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURELY
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _SPLIT.split(one) if w]
                if _WORDS.intersection(words) and not _NEUTRAL.intersection(words):
                    if _OWN.intersection(words) and not _WORDS.intersection(words) - {"header", "body"}:
                        continue
                    if _REMARKS.intersection(words):
                        return SURELY
                    doubt = MAYBE
    return doubt


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("start", name, attributes) and ("end", name, "") in order, in one pass.

    Where a quote of an attribute never closes, quotes mean nothing from there on.
    """
    tag, at, last = _TAG, 0, page.rfind(">")
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            begin = len(page)
        if begin > at:
            yield "text", "", page[at:begin]
        if begin == len(page):
            return
        follows = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = page.find(">", begin) if page.startswith((">", "->"), begin + 4) else page.find("-->", begin + 4)
            at = len(page) if end < 0 else page.find(">", end) + 1
        elif follows in ("!", "?") or follows == "/" and not page[begin + 2 : begin + 3].isalpha():
            at = page.find(">", begin) + 1
        elif not (follows == "/" or follows.isascii() and follows.isalpha()):
            yield "text", "", "<"
            at = begin + 1
        else:
            found = tag.match(page, begin)
            if not found:
                tag = _BARE_TAG
                found = tag.match(page, begin)
            if not found:
                yield "text", "", "<"
                at = begin + 1
                continue
            at, name = found.end(), found[2].lower()
            if found[1]:
                yield "end", name, ""
            elif name in _RAW:
                close = _RAW[name].search(page, at)
                at = page.find(">", close.end()) + 1 if close else len(page)
                at = at or len(page)
            else:
                yield "start", name, found[3]


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page that have text, in order."""
    stack: list[tuple[str, int, int]] = []  # name, and what held outside of it
    open_names: Counter[str] = Counter()
    out, inside = NOT, 0
    parts: list[str] = []
    linked, link, heading = 0, False, False

    def leave(upto: int) -> None:
        nonlocal out, inside
        while len(stack) > upto:
            name, out, inside = stack.pop()
            open_names[name] -= 1

    def flush() -> Iterator[Block]:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            yield Block(text, linked, inside, out, heading)
        parts, linked = [], 0

    for kind, name, rest in tokens(page):
        inline = name in _INLINE
        if kind == "text":
            text = html.unescape(rest)
            parts.append(text)
            if link:
                linked += len(text.strip())
        elif name in _VOID:
            if name in ("br", "hr"):
                parts.append(" ")
        elif kind == "start":
            if not inline:
                yield from flush()
                ended = _ENDS.get(name, _ENDS["p"])
                while stack and stack[-1][0] in ended:
                    leave(len(stack) - 1)
                heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
            link = name == "a" or link and inline
            gone = max(out, _excluded(name, rest, inside))
            if inline and gone > out:
                yield from flush()  # its text must not mix with that around it
            if not inline or gone:
                stack.append((name, out, inside))
                open_names[name] += 1
                landmark = 1 if name == "article" else 2 if name == "main" else 0
                if landmark and inside == 0 and out == MAYBE and gone == MAYBE:
                    inside, gone = landmark + WRAPPED, NOT
                elif landmark == 1 and inside in (0, 2) or landmark == 2 and inside == 0:
                    inside = landmark
                elif landmark == 1 and inside == 2 + WRAPPED:
                    inside = 1 + WRAPPED
                out = gone
        else:
            link = link and name != "a"
            if open_names[name] > 0:
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                yield from flush()
                leave(at)
            elif not inline:
                yield from flush()
            if not inline:
                heading = False
    yield from flush()


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]#*$%&|<>+-_/") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"


def knows_language(found: list[Block]) -> bool:
    """Whether the text outside links has stop words enough to judge single blocks by them."""
    text = " ".join(b.text for b in found if b.linked <= MOST_LINKED * len(b.text))
    return not text or stop_share(text) >= MANY_STOPS  # keywords of code are stop words too


def weight(text: str) -> int:
    """Code points, of scripts that write a word in one or two of them three each."""
    return len(text) + 2 * sum("\u2e80" <= c <= "\ud7ff" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000" for c in text)


def first_pass(block: Block, bounded: bool, known: bool = True) -> str:
    """A block judged by itself: good or bad, near good, or open; by length and links alone unless ``known``."""
    if block.linked > MOST_LINKED * len(block.text):
        return BAD
    if not known:
        size = weight(block.text)
        return GOOD if size >= LONG else NEAR if size >= SHORT else OPEN
    if len(block.text) < SHORT:
        return OPEN
    share = stop_share(block.text)
    if share >= MANY_STOPS and len(block.text) >= LONG:
        return GOOD
    if share >= FEW_STOPS:
        return NEAR
    return OPEN if bounded else BAD


def second_pass(labels: list[str], bounded: bool) -> list[bool]:
    """Whether each block is content; open ones take after the nearest decided blocks on both sides.

    Where these differ, a block that is near good is content, another follows the
    nearer one, and the one before it at equal distance. Open blocks with no decided
    one, or inside an article none that is good, are content.
    """
    n = len(labels)
    before: list[int | None] = []
    last = None
    for i, label in enumerate(labels):
        before.append(last)
        last = i if label in (GOOD, BAD) else last
    after: list[int | None] = [None] * n
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in (GOOD, BAD) else last
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        sides = {labels[j] for j in near}
        if bounded and GOOD not in sides or not sides:
            out.append(True)  # nothing but links, if anything, is decided against
        elif len(sides) == 1 or label != NEAR:
            out.append(labels[min(near, key=lambda j: abs(j - i))] == GOOD)
        else:
            out.append(True)
    return out


def _latin(text: str) -> bool:
    """Whether most letters are of the script whose stop words are known."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" for c in letters) >= len(letters)


def _judged(found: list[Block], bounded: bool) -> list[str]:
    known = bounded or knows_language(found)
    return [first_pass(b, bounded, known and (bounded or _latin(b.text))) for b in found]


def _bounds(found: list[Block]) -> int:
    """The landmark whose blocks are the content: an article, else main, else such a one in a wrapper with most of the text; 0 if none."""
    size = {at: sum(len(b.text) - b.linked for b in found if b.inside == at) for at in range(5)}
    within = {b.inside for b in found}
    for at in (1, 2):
        if at in within:
            return at
    for at in (1 + WRAPPED, 2 + WRAPPED):
        if size[at] > size[0]:
            return at
    return 0


def main_text(page: str) -> str:
    """The main text of a page: its content blocks in order, joined by one space; empty if there are none."""
    # What markup excludes is decided and tells nothing about the text beside it.
    every = list(blocks(page))
    found = [b for b in every if b.out == NOT]
    bound = _bounds(found)
    found = [b for b in found if b.inside == bound]
    labels = _judged(found, bound > 0)
    if not bound and GOOD not in labels:
        doubtful = [b for b in every if b.out == MAYBE]
        again = _judged(doubtful, False)
        if GOOD in again:
            found, labels = doubtful, again
    return " ".join(b.text for b, keep in zip(found, second_pass(labels, bound > 0)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """All rows and columns of ``pages`` with main_text added.

    Reads the whole html of each row by itself. Null and empty html have empty
    text, and so has a page without content. A column of that name is replaced.
    """
    pages = pages.drop("main_text")
    shown = pages.columns

    def run(batches):
        for batch in slices(batches):
            out = pa.array([main_text(page) for page in texts(batch, "html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), out], [*shown, "main_text"])

    return pages.mapInArrow(run, extended(pages.schema, {"main_text": "string"}))
