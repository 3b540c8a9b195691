"""Everything a page says, by a tokeniser that accounts for every character.

A page is read once, in the states of HTML: text, comment, declaration, tag, attribute, raw text. Each token
says which characters it covers and what of them is content. Characters between tokens that are neither blank
nor a delimiter of markup are content too (``discarded``): the complement of what is covered. So no spelling of
a page, however broken, hides a word.

Kinds of content: text (also before the first and behind the last tag, and inside raw-text elements),
comment, directive (a doctype other than HTML's, processing instructions), element-name and attribute-name
(those that no standard names; of ``data-`` names the rest), attribute (values that keep to no closed grammar),
discarded (attributes of end tags, strays) and unfinished (a comment, declaration or tag without its end).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Names of elements of HTML (current, then obsolete) and of drawings in SVG.
ELEMENTS = frozenset(
    """a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col
    colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter
    nav noscript object ol optgroup option output p picture pre progress q rp rt ruby s samp script search section
    select slot small source span strong style sub summary sup table tbody td template textarea tfoot th thead time
    title tr track u ul var video wbr
    acronym applet basefont big center dir font frame frameset marquee nobr noframes param strike tt
    svg g path circle ellipse rect line polyline polygon text tspan defs use symbol desc lineargradient
    radialgradient stop clippath mask pattern""".split()
)
# Names of attributes of HTML, states of ARIA, and attributes of drawings.
ATTRIBUTES = frozenset(
    """abbr accept accept-charset accesskey action align allow alt async autocapitalize autocomplete autofocus autoplay
    bgcolor border cellpadding cellspacing charset checked cite class color cols colspan content contenteditable
    controls coords crossorigin datetime default defer dir disabled download draggable enctype enterkeyhint for form
    formaction formmethod formnovalidate formtarget headers height hidden high href hreflang http-equiv id inert
    inputmode integrity is ismap itemid itemprop itemref itemscope itemtype kind label lang list loading loop low max
    maxlength media method min minlength multiple muted name nomodule nonce novalidate open optimum pattern ping
    placeholder playsinline poster preload readonly referrerpolicy rel required reversed role rows rowspan sandbox
    scope selected shape size sizes slot span spellcheck src srcdoc srclang srcset start step style tabindex target
    title translate type usemap valign value width wrap
    aria-busy aria-checked aria-controls aria-current aria-describedby aria-disabled aria-expanded aria-haspopup
    aria-hidden aria-label aria-labelledby aria-live aria-modal aria-pressed aria-selected
    clip-path clip-rule cx cy d fill fill-opacity fill-rule focusable gradienttransform opacity points
    preserveaspectratio r rx ry stroke stroke-linecap stroke-linejoin stroke-width transform viewbox x x1 x2 xmlns
    xmlns:xlink y y1 y2""".split()
)
RAW_TEXT = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"))
DELIMITERS = "<>/=\"'"

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_DOCTYPE = re.compile(r"(?i)doctype\s+html\s*")


class Atom(NamedTuple):
    """A piece of content: ``page[start:end]`` is ``value``, but for the strays of ``discarded``."""

    kind: str
    name: str | None
    value: str
    start: int
    end: int


class Scanner:
    """One page's atoms; ``closed`` says whether an attribute's value keeps to a closed grammar."""

    def __init__(self, page: str, closed):
        self.page, self.closed, self.covered = page, closed, []

    def _atom(self, kind: str, start: int, end: int, name: str | None = None) -> Atom:
        self.covered.append((start, end))
        return Atom(kind, name, self.page[start:end], start, end)

    def tokens(self) -> Iterator[Atom]:
        page, at, raw = self.page, 0, None
        while at < len(page):
            if raw:
                stop = re.compile(rf"(?i)</{raw}(?=[\s/>])").search(page, at)
                end = stop.start() if stop else len(page)
                yield self._atom("text", at, end)
                at, raw = end, None
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                if end < 0:
                    yield self._atom("unfinished", at, len(page))
                    return
                self.covered += [(at, at + 4), (end, end + 3)]
                yield self._atom("comment", at + 4, end)
                at = end + 3
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                if end < 0:
                    yield self._atom("unfinished", at, len(page))
                    return
                self.covered += [(at, at + 2), (end, end + 1)]
                if page[at + 1] == "!" and _DOCTYPE.fullmatch(page, at + 2, end):
                    self.covered.append((at + 2, end))
                else:
                    yield self._atom("directive", at + 2, end)
                at = end + 1
            elif page[at] == "<" and (name := _NAME.match(page, at + 1 + page.startswith("</", at))):
                found, end = self._tag(at, name)
                yield from found
                raw = name[0].lower() if name[0].lower() in RAW_TEXT and page[at + 1] != "/" and end < len(page) else None
                at = end
            else:
                end = page.find("<", at + 1)
                end = len(page) if end < 0 else end
                yield self._atom("text", at, end)
                at = end

    def _tag(self, at: int, name: re.Match) -> tuple[list[Atom], int]:
        """The atoms of the tag at ``at`` and where it ends."""
        page, end_tag, pos, seen = self.page, self.page[at + 1] == "/", name.end(), []
        while pos < len(page) and page[pos] != ">":
            if page[pos].isspace() or page[pos] == "/":
                pos += 1
                continue
            label = _ATTRIBUTE.match(page, pos)
            pos = label.end()
            equals = _EQUALS.match(page, pos)
            if not equals:
                seen.append((label.start(), label.end(), 0, 0))
                continue
            pos = equals.end()
            quote = page[pos : pos + 1]
            if quote in ('"', "'") and quote:
                stop = page.find(quote, pos + 1)
                if stop < 0:
                    pos = len(page)
                    break
                seen.append((label.start(), label.end(), pos + 1, stop))
                pos = stop + 1
            else:
                stop = _BARE.match(page, pos).end()
                seen.append((label.start(), label.end(), pos, stop))
                pos = stop
        if pos >= len(page):
            return [self._atom("unfinished", at, len(page))], len(page)
        self.covered += [(at, name.start()), (pos, pos + 1)]
        found = []
        if name[0].lower() in ELEMENTS:
            self.covered.append(name.span())
        else:
            found.append(self._atom("element-name", *name.span()))
        for a, b, c, d in seen:
            found += [self._atom("discarded", x, y) for x, y in ((a, b), (c, d)) if x < y] if end_tag else self._attribute(a, b, c, d)
        return found, pos + 1

    def _attribute(self, a: int, b: int, c: int, d: int) -> list[Atom]:
        label = self.page[a:b].lower()
        found = []
        if label.startswith("data-") and b - a > 5:
            self.covered.append((a, a + 5))
            found.append(self._atom("attribute-name", a + 5, b))
        elif label in ATTRIBUTES:
            self.covered.append((a, b))
        else:
            found.append(self._atom("attribute-name", a, b))
        if c < d and self.closed(label, self.page[c:d]):
            self.covered.append((c, d))
        elif c < d:
            found.append(self._atom("attribute", c, d, label))
        return found

    def gaps(self) -> Iterator[Atom]:
        """What no token covers, delimiters of markup aside."""
        at = 0
        for a, b in [*sorted(self.covered), (len(self.page), len(self.page))]:
            if a > at and self.page[at:a].strip().strip(DELIMITERS).strip():
                yield Atom("discarded", None, self.page[at:a], at, a)
            at = max(at, b)


def atoms(page: str | None, closed) -> list[Atom]:
    """The atoms of a page that are not blank; a null page has none."""
    scanner = Scanner(page or "", closed)
    found = list(scanner.tokens())
    return [a for a in [*found, *scanner.gaps()] if a.value.strip()]
