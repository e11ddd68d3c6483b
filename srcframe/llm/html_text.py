"""Main text of web pages by line-block distribution.

Markup is stripped so that each block (paragraph, heading, list item, cell ...) becomes a
line. Parts that can hold no article (menus, headers, footers, forms, scripts, adverts,
comments ...) become empty lines. A line's length is the number of its characters outside
links. Lengths are summed over a sliding window of lines: where a sum first reaches the
surge height the text begins, where a whole window is empty it dives and ends. The text
runs from the last empty window before a surge to the dive after it. A dive at a part that
was left out does not end the text where prose (paragraphs, headings, list items) goes on
beside it.

Where a page names its article (``article`` or ``main``) and that holds most of the page's
text outside links, only lines inside it count, and each of them counts.

Tags are found in one pass that never looks twice at what lies behind a ``<``, so the time
grows with the length of the page, whatever is in it.

Defined results: null and empty pages, and pages without text, give the empty text.
Unclosed elements end with the one around them or with the page. A lone ``<`` is text, and
so is a tag that never ends; where only its quotes do not, it ends at its first ``>``.
"""

from __future__ import annotations

import bisect
import dataclasses
import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.common import map_texts


@dataclasses.dataclass(frozen=True)
class Settings:
    window: int = 3
    # characters a window must hold to begin a text; less if no window of the page has as many
    surge: int = 80


# Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
# Elements without article text. ``header`` counts only outside the article.
DROPPED = frozenset(
    "nav footer aside form button select dialog menu iframe object svg canvas audio video map noscript template "
    "fieldset label datalist applet embed".split()
)
# Words in class, id or role that name such a part.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner "
    "banners menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars side rail footer foot masthead "
    "comment comments commentlist disqus discussion replies reply notice notices cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager toolbar widget widgets search contentinfo complementary alert alertdialog hidden".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))

RAW = frozenset("script style title textarea xmp noembed noframes".split())
OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-z][^\s/>]*))", re.I)
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.I)
CUT = re.compile(r"[^a-z]+")
# A compound names a part if it begins with a part's word, after words of place at most, and goes
# on with such words or these.
PLACES = frozenset(
    "area articles bar block body box boxes button buttons cell col column container content form group icon icons inner "
    "input item items left link links list outer panel post posts region right row section slot stories top bottom unit wrap "
    "wrapper".split()
)
BEFORE = frozenset("article bottom global left main mobile page post primary reader right secondary site sub top user".split())
# Words that only name a part when they stand alone.
ALONE = frozenset("hidden foot rail search contentinfo complementary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are prose where no container is drawn around them.
PROSE = HEADINGS | frozenset("p li blockquote pre dd dt figcaption td th".split())
# Inside an article these ids name a chapter.
CHAPTERS = frozenset(
    "alert banner banners cookie cookies consent discussion foot gdpr login menu menus modal navigation notice notices overlay "
    "popup promotion rail related replies reply search share sharing side signup social sponsor sponsors subscription toolbar "
    "widget widgets".split()
)
# Elements that may be laid around a whole page.
AROUND = frozenset(("form", "fieldset"))


def is_part(token: str) -> bool:
    words = [w for w in CUT.split(token) if w]
    if len(words) == 1:
        return words[0] in PARTS
    named = [w for w in words if w in PARTS]
    if not named or named[0] in ALONE or not all(w in PARTS or w in PLACES or w in BEFORE for w in words):
        return False
    return all(w in BEFORE for w in words[:words.index(named[0])])


def names_part(attributes: str, inside: bool = False) -> bool:
    """Whether class, id, role or a hiding attribute says that an element is no text of the article."""
    if not attributes or attributes.isspace():
        return False
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found.group(1).lower(), (found.group(2) or found.group(3) or found.group(4) or "")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and NO_DISPLAY.search(value):
            return True
        if name in ("class", "id", "role"):
            for token in value.lower().split():
                if is_part(token) and not (inside and name == "id" and token in CHAPTERS):
                    return True
    return False


@dataclasses.dataclass
class Tag:
    start: int
    end: int
    name: str  # empty for comments and declarations
    closing: bool
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page, with raw elements as one tag without a name.

    From each tag the search for its end goes from quote to quote. A place from which no end
    was found is remembered, so no stretch is walked twice in vain.
    """
    stops = [m.start() for m in STOP.finditer(page)]
    last = {c: page.rfind(c) for c in "\"'>"}
    vain: set[int] = set()

    def end_of(at: int) -> int:
        """Place after the ``>`` that ends a tag, or -1."""
        walked, place = [], bisect.bisect_left(stops, at)
        while place < len(stops) and place not in vain and last[">"] >= stops[place]:
            here = stops[place]
            if page[here] == ">":
                return here + 1
            walked.append(place)
            if last[page[here]] == here:
                break
            place = bisect.bisect_left(stops, page.find(page[here], here + 1) + 1)
        vain.update(walked)
        return -1

    at = 0
    while (found := OPEN.search(page, at)) is not None:
        start, name = found.start(), (found.group(2) or "").lower()
        if found.group() == "<!--":
            close = page.find("-->", found.end())
            at = len(page) if close < 0 else close + 3
            yield Tag(start, at, "", False, "")
            continue
        if last[">"] < found.end():
            return  # nothing ends from here on
        if not name:
            at = page.find(">", found.end()) + 1
            yield Tag(start, at, "", False, "")
            continue
        end = end_of(found.end())
        at = end if end > 0 else page.find(">", found.end()) + 1
        closing = found.group(1) == "/"
        attributes = page[found.end():at - 1]
        if name in RAW and not closing:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = len(page) if close is None else close.end()
            name = ""
        yield Tag(start, at, name, closing, attributes)


def around_text(page: str, found: list[Tag]) -> frozenset[int]:
    """Where forms begin that hold most of the page's text outside links and controls."""
    if not any(tag.name in AROUND for tag in found):
        return frozenset()
    opened: list[tuple[str, int, int]] = []
    held: list[tuple[int, int]] = []
    total = links = muted = at = 0
    for tag in found:
        if not links and not muted:
            total += len(" ".join(page[at:tag.start].split()))
        at = tag.end
        if tag.name == "a":
            links = 0 if tag.closing else 1
        elif tag.name in AROUND:
            if not tag.closing:
                opened.append((tag.name, tag.start, total))
            elif opened and opened[-1][0] == tag.name:
                _, start, before = opened.pop()
                held.append((start, total - before))
        elif tag.name in DROPPED and tag.name not in VOID:
            muted = max(0, muted - 1) if tag.closing else muted + 1
    if not links and not muted:
        total += len(" ".join(page[at:].split()))
    held += [(start, total - before) for _, start, before in opened]
    return frozenset(start for start, n in held if 2 * n > total)


@dataclasses.dataclass
class Line:
    text: str
    length: int
    inside: bool
    prose: bool = False


def lines_of(page: str, window: int) -> list[Line]:
    """Lines in page order, with empty ones where a part was left out or an article begins or ends."""
    lines: list[Line] = []
    text: list[str] = []
    state = {"links": 0, "linked": 0}
    skipped, depth = "", 0  # the element being left out, and how many of its name are open
    inside = 0  # open article elements
    found = list(tags(page))
    around = around_text(page, found)
    block = ""  # the element that the line stands in

    def end_line():
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            # a link's share is measured before references are resolved; it only weighs lines
            lines.append(Line(words, max(0, len(words) - state["linked"]), inside > 0, block in PROSE))
        text.clear()
        state["linked"] = 0

    def gap(empty: int):
        end_line()
        lines.extend([Line("", 0, False)] * empty)

    def add(piece: str):
        if piece and not skipped:
            text.append(piece)
            if state["links"]:
                state["linked"] += len(piece)

    at = 0
    for tag in found:
        add(page[at:tag.start])
        at, name, closing = tag.end, tag.name, tag.closing
        if not name:
            continue
        if skipped:
            if name == skipped:
                depth += -1 if closing else 1
                if depth <= 0:
                    skipped = ""
            elif not closing and name in ARTICLE and not inside and not names_part(tag.attributes):
                skipped = ""  # an unclosed part before the article
            elif closing and name in ARTICLE and inside:
                skipped = ""  # an unclosed part in the article
            if skipped or name not in ARTICLE:
                continue
        if name == "br":
            add(" ")
        elif name == "a":
            state["links"] = 0 if closing else 1
        elif not closing and name not in VOID and tag.start not in around and (
                name in DROPPED or name == "header" and not inside or name not in HEADINGS and names_part(tag.attributes, inside > 0)):
            if name not in ("html", "body"):
                if inside:
                    end_line()
                else:  # an advert inside a text does not end it, a menu does
                    gap(window if name in DROPPED or name == "header" else 1)
                skipped, depth = name, 1
        elif name in ARTICLE:
            if not closing:
                if not inside:
                    gap(window)
                else:
                    end_line()
                inside += 1
            elif inside:
                end_line()
                inside -= 1
                if not inside:
                    gap(window)
        elif name in BLOCKS:
            end_line()
            state["links"] = 0
            block = "" if closing else name
    add(page[at:])
    end_line()
    return lines


def main_text(page: str, settings: Settings = Settings()) -> str:
    lines = lines_of(page, settings.window)
    inside = sum(line.length for line in lines if line.inside)
    named = inside > 0 and 2 * inside >= sum(line.length for line in lines)
    if named:  # a line of links alone is text of the article as well
        lengths = [max(line.length, 1) if line.inside and line.text else 0 for line in lines]
    else:
        lengths = [line.length for line in lines]
    if not any(lengths):
        return ""
    wide = settings.window
    sums, total = [], sum(lengths[:wide])
    for i, length in enumerate(lengths):
        sums.append(total)
        total += (lengths[i + wide] if i + wide < len(lengths) else 0) - length
    height = min(settings.surge, max(sums))
    stretches: list[tuple[int, int, bool]] = []  # from dive to dive, and whether a surge lies between
    start, surged = 0, False
    for i in range(len(lines) + 1):
        if i == len(lines) or sums[i] == 0:  # dive
            if start < i:
                stretches.append((start, i, surged))
            start, surged = i + 1, False
        elif sums[i] >= height:
            surged = True
    kept: list[str] = []
    surges = [n for n, (_, _, surged) in enumerate(stretches) if surged]
    for n, (first, stop, surged) in enumerate(stretches):
        beside = surges and (n - 1 in surges or n + 1 in surges)
        for line in lines[first:stop]:
            if line.text and (line.inside or not named) and (surged or beside and line.prose and line.length):
                kept.append(line.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, settings: Settings = Settings(), column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every page, in place."""
    def make():
        return lambda found: [[main_text(p, settings) for p in found]]

    return map_texts(pages, column, make, "text string", keep).withColumn("n_chars", F.char_length("text").cast("bigint"))
