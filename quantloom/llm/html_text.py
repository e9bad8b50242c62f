"""Main text of web pages by line-block distribution.

Markup is stripped first: every block element gives one line, inline elements leave no trace, character
references are decoded and white space inside a line becomes one space.  Elements that are not part of
an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments,
hidden elements) give no text.

The length of a line is the number of its characters that may be main text: all of them inside an
``article`` element (else ``main``, else a container named as content), none outside of it; on pages
without such an element, those outside of links, and none where links make up most of the line.  Where a stripped element lies outside of the article it
leaves ``WINDOW`` lines of length 0, inside of it nothing, so that an advert does not cut an article in two.

The lengths are summed over sliding windows of ``WINDOW`` lines.  A surge point is where the sums rise from
zero, a dive point where they have fallen to it.  The text between the two is kept if a window between them
holds ``SURGE`` characters, and in any case where the sums are largest; on pages with an article element every
stretch is kept, since the element itself vouches for it.  The first and last lines of a stretch without
length (link lines in the margin of a window) are left out.

Pages are read in one pass with a stack of open elements; an end tag without its start tag is ignored
in constant time, so broken and very long pages take linear time.

Defined cases: null, empty and text-free pages give an empty text; pages cut off in the middle of a tag, comment or
script end there; repeated rows are extracted alike; other columns travel in ``row``; an empty table gives an empty result.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import map_rows

#: Lines of a window, and characters in a window that make a surge.
WINDOW, SURGE = 3, 60

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is not part of an article, and the roles that say the same.
NOISE = frozenset("""aside button canvas datalist dialog fieldset footer form head header input label legend menu nav noscript object optgroup option output progress search select
    svg template audio video""".split())
NOISE_ROLES = frozenset("alert alertdialog banner button complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name what is not part of an article.
NOISE_WORDS = frozenset("""ad ads adsense adsbygoogle advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu
    modal nav navbar navigation newsletter notice notices popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe
    toolbar widget""".split())
#: Words that make an element a header; headings may carry them and stay.
HEADER_WORDS = frozenset("header masthead".split())
#: First words of a class that only says whether something is there.
MODIFIERS = frozenset("has have hide is js no not show with without".split())
#: Classes and ids of the container of an article.
CONTENT = frozenset("""article article-body article-content articlebody content content-body entry entry-content main main-content maincontent post post-body post-content story
    story-body""".split())
#: Noise that only says where on the page it stands: an article inside of it counts nevertheless.
LAYOUT = frozenset("form header nav fieldset".split())
#: Blocks that may stand in the head of a page.
IN_HEAD = frozenset("title noscript".split())
#: Open elements looked through for the one that a tag closes.
DEPTH = 512
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new one of these closes the open one before it.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table select article section div body main aside nav form".split())

TAG = re.compile(r"""<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|(?P<odd>[!?][^>]*(?:>|\Z))
    |(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z))""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: A line that begins like this is a footer wherever it stands.
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)\s", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def noisy(name: str, attributes: dict[str, str]) -> int:
    """2 if an element holds no article text, by its name, role, visibility, class or id; 1 if it is only a part of the layout; else 0."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return 2
    level = 1 if name in LAYOUT else 2 * (name in NOISE or attributes.get("role", "").lower() in NOISE_ROLES)
    if name in ("html", "body", "main"):
        return level
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = re.split(r"[-_]+", token)
        if words[0] not in MODIFIERS:
            if not NOISE_WORDS.isdisjoint(words):
                return 2
            if name not in HEADINGS and not HEADER_WORDS.isdisjoint(words):
                level = max(level, 1)
    return level


def rank(name: str, attributes: dict[str, str]) -> int:
    """How surely an element holds the article: 3 article, 2 main, 1 named so, 0 not at all."""
    role = attributes.get("role", "").lower()
    if name == "article" or role == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return 3
    if name == "main" or role == "main":
        return 2
    return int(name in BLOCK and not CONTENT.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()))


class Lines:
    """Lines of a page: text, its characters outside of links, and the surest container (3 article .. 0 none)."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.plain: list[int] = []
        self.ranks: list[int] = []
        self._parts: list[tuple[str, bool]] = []

    def add(self, text: str, in_link: bool) -> None:
        self._parts.append((text, in_link))

    def end(self, rank_: int) -> None:
        if self._parts:
            text = " ".join("".join(t for t, _ in self._parts).split())
            if text:
                self.texts.append(text)
                plain = sum(len("".join(t.split())) for t, in_link in self._parts if not in_link)
                self.plain.append(plain if 2 * plain >= len("".join(text.split())) and not COPYRIGHT.match(text) else 0)
                self.ranks.append(rank_)
            self._parts = []

    def gap(self, rank_: int) -> None:
        """Empty lines in the place of a stripped element; none inside of an article."""
        if not rank_:
            self.texts += [""] * WINDOW
            self.plain += [0] * WINDOW
            self.ranks += [0] * WINDOW


def lines_of(page: str) -> Lines:
    """One line per block of the page."""
    out = Lines()
    # open elements: name, noise outside of it, container rank outside of it
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    noise = links = container = at = 0  # noise: 0 text, 1 layout only, 2 noise

    def pop() -> None:
        nonlocal noise, container
        name, before, rank_ = stack.pop()
        opened[name] -= 1
        if noise and not before:
            out.gap(rank_)
        noise, container = before, rank_

    def close(names: set[str] | frozenset[str], until: frozenset[str]) -> None:
        """Close the nearest open element of these names, unless one of ``until`` lies before it."""
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in until:
                return

    def text(raw: str) -> None:
        if noise == 0 or (noise == 1 and container and opened_heading()):
            out.add(html.unescape(raw), links > 0)

    def opened_heading() -> bool:
        return any(opened[h] for h in HEADINGS)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = TAG.match(page, start)
        if m is None:  # a bare "<" is text
            text(page[at:start + 1])
            at = start + 1
            continue
        if start > at:
            text(page[at:start])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"].replace("&", "&amp;"))
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                links = 0
            if name in BLOCK:
                out.end(container)
                if opened[name]:
                    close({name}, frozenset())
            elif stack and stack[-1][0] == name:  # an inline element is on the stack only inside noise
                pop()
            continue
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m["attributes"])} if m["attributes"] else {}
        if name in BLOCK:
            out.end(container)
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                pop()
            close({"p"}, HOLDERS)
            if name in SIBLINGS:
                close(SIBLINGS[name], HOLDERS - {"table"} if name == "tr" else HOLDERS)
        elif name == "br":
            text(" ")
        if name == "a":
            links = 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            stop = page.find(">", at)
            at = len(page) if stop < 0 else stop + 1
            continue
        if name in VOID or m["attributes"].endswith("/") and name not in BLOCK:
            continue
        surest, bad, inside = rank(name, attributes), noisy(name, attributes), noise
        if surest >= 2 and noise == 1 and bad < 2:  # a form or header around an article does not hide it
            inside = 0
        elif bad:  # the header of an article keeps its headings; its forms and menus keep nothing
            inside = max(noise, 2 if container and name in LAYOUT and name != "header" else bad)
        if name in BLOCK or inside != noise or (stack and stack[-1][0] not in BLOCK):
            stack.append((name, noise, container))
            opened[name] += 1
            noise = inside
            if not inside:
                container = max(container, surest)
    out.end(container)
    return out


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of the line lengths."""
    if not page:
        return ""
    lines = lines_of(page)
    if not lines.texts:
        return ""
    surest = max(lines.ranks)
    if surest:
        length = np.array([len(t) if r == surest else 0 for t, r in zip(lines.texts, lines.ranks)])
    else:
        length = np.array(lines.plain)
    # sums over windows that begin before the first line and end after the last one
    total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(WINDOW - 1, int), length, np.zeros(WINDOW - 1, int)]))])
    sums = total[WINDOW:] - total[:-WINDOW]
    edge = np.diff(np.concatenate([[0], (sums > 0).astype(int), [0]]))
    stretches = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))  # surge and dive points
    if not stretches:
        return ""
    peak = max(sums[a:b].max() for a, b in stretches)
    kept: list[str] = []
    for a, b in stretches:
        if surest or sums[a:b].max() >= min(SURGE, peak):
            first, last = a, b - WINDOW  # window i covers the lines i - WINDOW + 1 .. i
            kept += [t for t, r in zip(lines.texts[first:last + 1], lines.ranks[first:last + 1]) if t and r == surest]
    return " ".join(kept)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """row (all columns but the markup), text, n_chars."""
    chosen = pages.select(F.struct(*[c for c in pages.columns if c != markup]).alias("row"), F.col(markup).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    return map_rows(chosen, extracted, f"row {chosen.schema['row'].dataType.simpleString()}, text string, n_chars bigint")
