"""Substitution of given values in pages, in whatever way each of their characters is written.

A page is read as a run of characters with the spelling that each has there: as it is, as a numeric
or named reference (with or without its semicolon), percent-encoded, or ``+`` for a blank. Runs of
blanks count as one, invisible format characters as nothing, combining marks are composed and case
does not matter. The values are found on that run by one automaton, so a page is read once however
many values there are. What replaces a value is written in capitals where the value was; its signs
keep the spelling that they had in the value. Longer values go first, and a replacement is never
searched again.

The values are a broadcast of at most ``MOST_CHARACTERS`` characters in all, which is checked; they are not part of
the plan.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.markup import strip_code, unformatted

MOST_CHARACTERS = 20_000_000
QUERY_SIGNS = "&=?#"
MARKUP_SIGNS = "\"'<>"
# It begins with a class of characters, which a search can skip to.
_CODED = re.compile(r"[&%](?:(?<=&)(?:#[xX](?P<hex>[0-9a-fA-F]{1,6});?|#(?P<dec>[0-9]{1,7});?|(?P<name>[A-Za-z][A-Za-z0-9]{1,31});)|(?<=%)(?P<percent>[0-9a-fA-F]{2}(?:%[0-9a-fA-F]{2})*))")
# A data URL (RFC 2397): media type and parameters, then ";base64," and the payload.
EMBEDDED = r"(?i)\bdata:[^\s\"'<>,]*;base64,[^\s\"'<>),;]*"


def unsafe(substitutions: dict[str, str]) -> list[str]:
    """Values whose replacement could change a page's structure: quotes or angle brackets, or a mark of a URL that the value lacks."""
    return sorted(a for a, b in substitutions.items() if not _folded(a).strip() or any(c in b for c in MARKUP_SIGNS) or any(c in b and c not in a for c in QUERY_SIGNS))


def _percent(run: str) -> list[tuple[str, int]]:
    """Characters of a percent-encoded run with the length of their spelling; bytes that are no UTF-8 stay as written."""
    raw, out, i = bytes.fromhex(run.replace("%", "")), [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + size].decode(), 3 * size))
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out += [(c, 1) for c in run[3 * i : 3 * i + 3]]
        i += size
    return out


# What may need more than a copy: characters beyond ASCII, several blanks, and blanks other than a space.
_RUNS = re.compile(r"[^\x00-\x7F]+|\s{2,}|[^\S ]")


class Starts:
    """Where the spelling of each character begins: runs of characters that follow one another in the page, by the first of each."""

    def __init__(self, firsts: list[int], places: list[int]):
        self.firsts, self.places = firsts, places

    def __getitem__(self, k: int) -> int:
        run = bisect_right(self.firsts, k) - 1
        return self.places[run] + k - self.firsts[run]


def characters(page: str) -> tuple[str, Starts]:
    """The page's characters, and where the spelling of each begins (with the page's length at the end)."""
    pieces: list[str] = []
    firsts: list[int] = []
    places: list[int] = []
    total = 0
    said = set(page)
    odd = {c for c in said if c > "\x7f" and (c.isspace() or unicodedata.category(c) == "Cf" or unicodedata.combining(c))}
    simple = not odd and "  " not in page and not any(c.isspace() for c in said - {" "})

    def put(text: str, at: int) -> None:
        nonlocal total
        pieces.append(text)
        firsts.append(total)
        places.append(at)
        total += len(text)

    def last() -> str:
        return pieces[-1][-1] if pieces else ""

    def add(c: str, at: int) -> None:
        if c.isspace():
            if last() != " ":
                put(" ", at)
        elif unicodedata.category(c) == "Cf":
            return
        elif pieces and unicodedata.combining(c) and len(both := unicodedata.normalize("NFC", last() + c)) == 1:
            pieces[-1] = pieces[-1][:-1] + both
        else:
            put(c, at)

    def copied(a: int, b: int) -> None:
        if page.startswith(" ", a, b) and last() == " ":
            a += 1
        if a < b:
            put(page[a:b], a)

    def plain(a: int, b: int) -> None:
        for m in () if simple else _RUNS.finditer(page, a, b):
            if m[0][0] > "\x7f" and odd.isdisjoint(m[0]):
                continue
            copied(a, m.start())
            for k, c in enumerate(m[0], m.start()):
                add(c, k)
            a = m.end()
        copied(a, b)

    done = 0
    for m in _CODED.finditer(page):
        plain(done, m.start())
        done = m.end()
        if m["percent"]:
            at = m.start()
            for c, size in _percent(m[0]):
                add(c, at)
                at += size
            continue
        if m["name"]:
            said = html.unescape(m[0])
        else:
            code = int(m["hex"], 16) if m["hex"] else int(m["dec"])
            said = chr(code) if 0 < code < 0x110000 else m[0]
        if len(said) == 1:
            add(said, m.start())
        else:
            plain(m.start(), m.end())
    plain(done, len(page))
    return "".join(pieces), Starts([*firsts, total], [*places, len(page)])


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def _lowered(text: str) -> str:
    """``_lower`` of each character; at once where no lower case is longer or depends on its place."""
    return "".join(map(_lower, text)) if "\u0130" in text or "\u03a3" in text else text.lower()


def _folded(value: str) -> str:
    return _lowered(characters(value)[0])


class Matcher:
    """An automaton of values; ``find`` gives their places in a page, longest values first."""

    def __init__(self, values: list[str]):
        import ahocorasick

        self.values = {}
        for v in sorted(values, key=lambda v: (-len(v), v)):
            key = _folded(v).strip()
            if key:
                self.values.setdefault(key, v)
        self.automaton = ahocorasick.Automaton()
        for key in self.values:
            self.automaton.add_word(key.replace("+", " "), (len(key), [*self._same(key.replace("+", " ")), key]))
        if self.values:
            self.automaton.make_automaton()

    def _same(self, word: str) -> list[str]:
        """Values that differ from another in ``+`` and blank only share its word."""
        return self.automaton.get(word, (0, []))[1]

    def find(self, page: str) -> tuple[list[tuple[int, int, str]], str, Starts]:
        """(first character, last character + 1, value) of hits that do not overlap, in order; and the page's characters and their starts."""
        chars, starts = characters(page)
        if not self.values:
            return [], chars, starts
        low = _lowered(chars)
        hits = []
        for end, (size, keys) in self.automaton.iter(low.replace("+", " ")):
            seen = low[end + 1 - size : end + 1]
            for key in keys:  # a plus sign in the page may be a blank, a blank is never a plus sign
                if all(a == b or (a == " " and b == "+") for a, b in zip(key, seen)):
                    hits.append((-size, end + 1 - size, key))
        taken, found = bytearray(len(chars)), []
        for size, at, key in sorted(hits):
            if not any(taken[at : at - size]):
                taken[at : at - size] = b"\1" * -size
                found.append((at, at - size, self.values[key]))
        return sorted(found), chars, starts


def _styled(new: str, value: str, found: str, spelled: list[str]) -> str:
    """The replacement with the signs that the value has too as they are spelled there, in capitals if what was found is."""
    style = {c: s for c, s in zip(_folded(value).strip(), spelled) if not c.isalnum()}
    letters = [c for c in found if c.isalpha()]
    caps = bool(letters) and all(c == c.upper() for c in letters) and any(c != c.lower() for c in letters)
    return "".join((c.upper() if caps else c) if c.isalnum() else style.get(c, c) for c in new)


def substituted(page: str, matcher: Matcher, replacements: dict[str, str]) -> str:
    found, chars, starts = matcher.find(page)
    out, done = [], 0
    for a, b, value in found:
        spelled = [page[starts[k] : starts[k + 1]] for k in range(a, b)]
        out += [page[done : starts[a]], _styled(replacements[value], value, chars[a:b], spelled)]
        done = starts[b]
    return "".join([*out, page[done:]])


def stripped(page: Column) -> Column:
    """The page without bodies of scripts and styles and without embedded base64 data."""
    return F.regexp_replace(strip_code(page), EMBEDDED, "data:,")


def redacted(pages: DataFrame, substitutions: dict[str, str], column: str = "html") -> DataFrame:
    """The pages, all columns, with ``column`` stripped and the values in it substituted; nulls stay null."""
    if bad := unsafe(substitutions):
        raise ValueError(f"unsafe replacements for {bad}")
    if sum(map(len, substitutions)) > MOST_CHARACTERS:
        raise ValueError(f"the values have more than {MOST_CHARACTERS} characters; take them in parts")
    shared = pages.sparkSession.sparkContext.broadcast(substitutions)

    @F.pandas_udf("string")
    def substitute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        given = shared.value
        matcher = Matcher(list(given))
        for batch in batches:
            yield batch.map(lambda page: None if page is None else substituted(page, matcher, given))

    return pages.withColumn(column, substitute(stripped(F.col(column))))


VIEWS = ("raw", "decoded", "rendered", "percent")


def rendered(page: str) -> str:
    """What a reader may see of a page: texts, attribute values and comments with every reference decoded, blanks and format characters as single blanks."""
    parts = []
    for m in re.finditer(r"<!--(.*?)-->|<[!/?a-zA-Z][^>]*>|([^<]+|<)", page, re.S):
        if m[1] is not None or m[2] is not None:
            parts.append(html.unescape(html.unescape(m[1])) if m[1] is not None else html.unescape(m[2]))
        else:
            parts += [html.unescape(v[0] or v[1] or v[2]) for v in re.findall(r"=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", m[0])]
    return " ".join(unformatted("\n".join(parts)).split())


def views(page: str) -> list[str]:
    """The page as it stands, with references decoded, as rendered, and with percent codes decoded."""
    return [page, html.unescape(page), rendered(page), unquote(page)]


def survivors(pages: DataFrame, forbidden: list[str], key: str = "page_id", column: str = "html") -> DataFrame:
    """key, value, view and n: the forbidden values that any view of a page still shows. Any row refuses the page."""
    shared = pages.sparkSession.sparkContext.broadcast(list(forbidden))
    kind = pages.schema[key].dataType.simpleString()

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[column]):
                counts: dict[str, Counter] = {}  # views that are the same are swept once
                for name, text in zip(VIEWS, views(page or "")):
                    if text not in counts:
                        counts[text] = Counter(value for _, _, value in matcher.find(text)[0])
                    out += [(k, v, name, n) for v, n in counts[text].items()]
            yield pd.DataFrame(out, columns=[key, "value", "view", "n"])

    return pages.select(key, column).mapInPandas(sweep, f"`{key}` {kind}, value string, view string, n long")


# What a page of each source says about an identity; each captures one.
DETECTORS = {
    "playername": r"playername=([^\"&']+)",
    "teamname": r"teamname=([^\"&']+)",
    "uaid": r"uaid[=:]([0-9]+)",
    "tennis-id": r"(?i)tennis-id=([a-z0-9]+)",
}


def unlisted(pages: DataFrame, allowed: DataFrame, detectors: dict[str, str] = DETECTORS, key: str = "page_id") -> DataFrame:
    """key, detector and value of the identities that pages show and ``allowed`` (value) lacks; case and form encoding do not count."""

    def hits(name: str, pattern: str) -> Column:
        shown = F.regexp_extract_all(F.replace("html", F.lit("&amp;"), F.lit("&")), F.lit(pattern), 1)
        return F.transform(shown, lambda v: F.struct(F.lit(name).alias("detector"), v.alias("value")))

    found = pages.select(key, F.inline(F.concat(*[hits(n, p) for n, p in detectors.items()]))).withColumn("value", F.coalesce(F.try_url_decode("value"), F.col("value"))).distinct()
    known = allowed.select(F.lower("value").alias("__v")).distinct()
    return found.join(known, F.lower("value") == F.col("__v"), "leftanti")
