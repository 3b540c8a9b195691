"""Text and page cleaning for publication: stripped markup, personal-data classes, skeletons, vocabulary."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rallyframe.functions import pagescan

# The kinds of street that end an address.
STREETS = ("St", "Street", "Ave", "Avenue", "Rd", "Road", "Dr", "Drive", "Ln", "Lane", "Blvd", "Boulevard", "Ct", "Court", "Way", "Ter", "Terrace")
# Classes that must never be published, from the grammars of addresses (RFC 6068, RFC 3966) and the
# numbering plan (area, exchange, line); all in the syntax that Java and RE2 share.
CLASSES = {
    "email": r"[^\s@<>\"'(),:;]+@(?:[^\s@<>\"'(),:;./?#&=]+\.)+\pL{2,}",
    "mailto": r"(?i)mailto:(?:[\w.!#$&*+/=?^`{|}~@,;:-]|%[0-9a-f]{2})+",
    "phone": r"(?:\([0-9]{3}\) ?[-.]?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}\b",
    "street": r"\b[0-9]{1,6}(?:\s+[A-Z][A-Za-z]+)+?\s+(?:" + "|".join(STREETS) + r")\b",
    "tel": r"(?i)tel:\+?(?:[-.() ]{0,3}[0-9]){7,15}",
}


def strip_code(page: Column) -> Column:
    """Bodies of scripts and styles removed."""
    return F.regexp_replace(F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>", "<script></script>"), r"(?is)<style[^>]*>.*?</style>", "<style></style>")


def title(page: Column) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(pages: DataFrame) -> DataFrame:
    """page_id, href and how often the page has it."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return pages.select("page_id", F.explode(found).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def first_hits(docs: DataFrame) -> DataFrame:
    """doc_id, class and the first hit of each class a text has."""
    hits = [F.struct(F.lit(k).alias("class"), F.regexp_extract("text", p, 0).alias("hit")) for k, p in sorted(CLASSES.items())]
    return docs.select("doc_id", F.inline(F.array(*hits))).where("hit <> ''")


# The runs of a page that count as structure, taken out in this order. Word characters are ASCII.
STRUCTURAL = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",  # a day as people write it
    r"\b\d{4}-\d{2}-\d{2}\b",  # a day in order of size
    r"\b\d+\.\d+\b",  # a decimal
    r"\d{1,2}-\d{1,2}(?:\s?\(\d{1,2}(?:-\d{1,2})?\))?",  # a set with its tiebreak
    r"#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b",  # a colour
    r"[MmLlHhVvCcSsQqTtAaZz](?:\s*-?\d+(?:\.\d+)?[,\s]*)+",  # path data of a drawing
    r"\b\d+\b",  # a whole number
)
_BEGIN, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"  # what a boundary says before a run and behind it


def skeleton(text: Column, stand_ins: list[str] | None = None) -> Column:
    """What is left of a text without stand-ins (whole words, longest first, any case) and structural runs: letters and digits of any script, single blanks.

    References, percent codes, invisible signs and combining marks are resolved first (``normalised``). Case is
    kept. ``stand_ins`` are a short list of made-up names; longer lists are substituted before.
    """
    text = F.coalesce(_normalised(F.when(text.rlike(r"[&%]|[^\x00-\x7F]"), text)), text)
    for s in sorted(filter(None, stand_ins or []), key=lambda s: (-len(s), s)):
        text = F.regexp_replace(text, "(?i)(?<![0-9A-Za-z_])" + re.escape(s) + "(?![0-9A-Za-z_])", " ")
    bare = text
    for p in STRUCTURAL:
        bare = F.regexp_replace(bare, re.sub(r"^\\b", lambda _: _BEGIN, p).replace(r"\b", _END), " ")
    text = F.when(text.rlike("[0-9#]"), bare).otherwise(text)  # every run has a digit or begins with the sign of a colour
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def unformatted(text: str) -> str:
    """A text with each format character as a blank."""
    for c in set(text):
        if c > "\x7f" and unicodedata.category(c) == "Cf":
            text = text.replace(c, " ")
    return text


def normalised(text: str) -> str:
    """A text with its references decoded until none is left, percent codes decoded, format characters as blanks, and composed (NFC)."""
    while (said := html.unescape(text)) != text:
        text = said
    text = unquote(text, errors="surrogateescape").encode("utf-8", "replace").decode() if "%" in text else text
    if not text.isascii():
        text = unicodedata.normalize("NFC", unformatted(text))
    return text


@F.pandas_udf(StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalised(t))


def off_vocabulary(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Lines whose skeleton is not empty and not in the vocabulary."""
    return lines.where("skeleton <> ''").join(vocabulary.select("skeleton").distinct(), "skeleton", "leftanti")


def needs_review(skeletons: Column) -> Column:
    """Name-shaped: two words of letters side by side, in any script and case."""
    return skeletons.rlike(r"\p{L}[\p{L}\p{M}'-]*\s+\p{L}")


# Parts of names that mark an input or meta element as a session's credential, and kinds of
# input whose value is a label.
CREDENTIAL_NAMES = ("csrf", "xsrf", "viewstate", "eventvalidation", "authenticity_token", "_token", "requestverification")
BUTTONS = ("submit", "button", "reset", "image")
OPAQUE = string.ascii_letters + string.digits + "+/=_.-"  # fixed as well: the signs of base64, of its form for URLs and of dotted tokens


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in either kind of quotes or bare; empty without it."""
    shape = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, shape, k) for k in (1, 2, 3)])


def session_credentials(pages: DataFrame) -> DataFrame:
    """page_id, tag and signal of the input and meta elements that look like a session's credential: hidden with a value, a marked name, or an opaque value of 64 characters or more.

    Tags are found in the text as it stands, so those inside raw-text containers are seen too.
    """
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<\s*((?:input|meta)[\s/][^>]*)>"), 1)).alias("tag"))
    named = F.lower(F.concat(_attribute(F.col("tag"), "name"), F.lit(" "), _attribute(F.col("tag"), "id")))
    value = F.concat(_attribute(F.col("tag"), "value"), _attribute(F.col("tag"), "content"))
    kind = F.lower(_attribute(F.col("tag"), "type"))
    marked = F.lit(False)
    for m in CREDENTIAL_NAMES:
        marked = marked | named.contains(m)
    opaque = (F.char_length(value) >= 64) & (F.translate(value, OPAQUE, "") == "") & (F.lower(_attribute(F.col("tag"), "http-equiv")) != "origin-trial")
    button = kind.isin(*BUTTONS)
    signal = F.when(button | (value == ""), None).when(marked, "name").when(opaque, "shape").when(kind == "hidden", "hidden")
    return tags.withColumn("signal", signal).where("signal IS NOT NULL")


_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_LIST = rf"\s*{_NUMBER}(?:[\s,]+{_NUMBER})*\s*"
# Attributes whose value may be published if it keeps to a closed grammar (of HTML and SVG): nothing else
# can be said in it.
CLOSED = {
    "colspan": "[0-9]+", "rowspan": "[0-9]+", "width": rf"{_NUMBER}(?:px|em|rem|ex|pt|pc|cm|mm|in|%)?", "height": rf"{_NUMBER}(?:px|em|rem|ex|pt|pc|cm|mm|in|%)?",
    "viewbox": rf"\s*{_NUMBER}(?:[\s,]+{_NUMBER}){{3}}\s*", "points": _LIST, "d": r"\s*[Mm][MmLlHhVvCcSsQqTtAaZz0-9eE+.,\s-]*",
    "fill": "(?i)none|currentcolor|transparent|inherit|#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", "stroke": "(?i)none|currentcolor|transparent|inherit|#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})",
    "transform": rf"(?:\s*(?:matrix|translate|scale|rotate|skewX|skewY)\({_LIST}\)[\s,]*)+", "xmlns": r"http://www\.w3\.org/[0-9]{4}/[A-Za-z0-9/]+", "xmlns:xlink": r"http://www\.w3\.org/[0-9]{4}/[A-Za-z0-9/]+",
    "focusable": "(?i)true|false|auto", "preserveaspectratio": r"(?i)\s*(?:none|x(?:min|mid|max)y(?:min|mid|max))(?:\s+(?:meet|slice))?\s*",
    "role": "(?i)alert|banner|button|cell|checkbox|columnheader|complementary|contentinfo|dialog|form|grid|group|heading|img|link|list|listitem|main|menu|menuitem|navigation|none|presentation|region|row|rowgroup|search|status|tab|table|tablist|tabpanel|textbox|toolbar",
    "type": "(?i)button|checkbox|color|date|email|file|hidden|image|number|password|radio|range|reset|search|submit|tel|text|time|url|text/css|text/html|text/javascript|application/json|application/javascript|module",
}


def is_closed(name: str, value: str) -> bool:
    """Whether an attribute's value keeps to the closed grammar of its name."""
    return name in _CLOSED and _CLOSED[name].fullmatch(value) is not None


_CLOSED = {n: re.compile(p) for n, p in CLOSED.items()}


def page_atoms(pages: DataFrame) -> DataFrame:
    """page_id, kind, name (of the attribute), value and n (how often) of what ``atoms`` finds."""
    return atoms(pages).groupBy("page_id", "kind", "name", "value").agg(F.count("*").alias("n"))


def atoms(pages: DataFrame) -> DataFrame:
    """page_id, kind, name (of the attribute) and value of everything a page would publish (``pagescan``), a row for each time.

    Values that keep to a closed grammar say nothing and are left out. Bodies of scripts and styles are
    texts: strip them first (``strip_code``) where they are not published. A null page says nothing.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids, kinds, names, values = [], [], [], []
                for k, page in enumerate(rows.column("html").to_pylist()):
                    for atom in pagescan.atoms(page, is_closed):
                        ids.append(k)
                        kinds.append(atom.kind)
                        names.append(atom.name)
                        values.append(atom.value.strip())
                text = pa.string()
                yield pa.record_batch([rows.column("page_id").take(pa.array(ids, pa.int64())), pa.array(kinds, text), pa.array(names, text), pa.array(values, text)], names=["page_id", "kind", "name", "value"])

    return pages.select("page_id", "html").mapInArrow(scan, f"page_id {kind}, kind string, name string, value string")
