"""What refuses a page: identities that it displays, classes that must never be published, and the whole check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions import markup, redact


class Shown(NamedTuple):
    """A text shown behind a mark: an attribute (``name``, and a value that ``marked`` finds), and at most ``within`` characters later the tag ``before`` the text. ``text`` captures the value."""

    name: str
    marked: str
    within: int
    before: str
    after: str
    text: str = r"^([\s\S]+)$"


# Where pages show whom they are about.
SHOWN = {
    "displayed name": Shown("data-element-name", "^fullName$", 400, "h3", "/h3"),
    "displayed location": Shown("data-element-name", "^nameGenderAddress$", 400, "/span", "br", r"^\s*\|\s*([^|]+?)\s*$"),
    "displayed profile": Shown("class", "playerDetailsHeader", 200, "h2", "/h2"),
}
_QUOTED = re.compile(r"(?<![A-Za-z-])(?=([A-Za-z-]+)\s*=\s*\"([^\"]*)\")")
_BETWEEN = re.compile(r"(?=<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]+)<(/?[A-Za-z][A-Za-z0-9]*))")  # tags may overlap in a broken page
AVATAR = r"(?i)/User/([0-9a-f-]{36})/"


def marks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, kind (attribute or text), name, value, start and end (of the attribute; of the tag before the text), before and after (tags around a text).

    They are found in the page as it stands, so a broken page hides none.
    """
    kind = pages.schema[key].dataType.simpleString()
    fields = ("kind", "name", "value", "start", "end", "before", "after")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for k, page in enumerate(batch.column("html").to_pylist()):
                found = [("attribute", m[1].lower(), m[2], m.start(), m.end(2) + 1, None, None) for m in _QUOTED.finditer(page or "")]
                found += [("text", None, m[2], m.start(), m.end(), m[1].lower(), m[3].lower()) for m in _BETWEEN.finditer(page or "")]
                rows += found
                ids += [k] * len(found)
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            yield pa.record_batch([batch.column(key).take(pa.array(ids, pa.int64())), *columns], names=[key, *fields])

    return pages.select(key, "html").mapInArrow(scan, f"`{key}` {kind}, kind string, name string, value string, start long, end long, before string, after string")


def displayed(pages: DataFrame, rules: dict[str, Shown] = SHOWN, key: str = "page_id") -> DataFrame:
    """key, detector and value of what pages show: for each mark the nearest fitting text within reach, and the ids of avatars.

    Marks and texts of a page are read once and passed in order of their places; a null page shows nothing.
    """
    spots = []
    for name, r in rules.items():
        marked = (F.col("kind") == "attribute") & (F.col("name") == r.name) & F.col("value").rlike(r.marked)
        text = (F.col("kind") == "text") & (F.col("before") == r.before) & (F.col("after") == r.after) & F.col("value").rlike(r.text)
        which, reach, nothing = F.lit(name).alias("detector"), F.lit(r.within).cast("long").alias("within"), F.lit(None)
        spots += [
            F.when(marked, F.struct(which, F.col("end").alias("place"), reach, nothing.cast("string").alias("shown"))),
            F.when(text, F.struct(which, F.col("start").alias("place"), nothing.cast("long").alias("within"), F.regexp_extract("value", r.text, 1).alias("shown"))),
        ]
    found = marks(pages, key).select(key, F.inline(F.filter(F.array(*spots), lambda x: x.isNotNull())))
    # From the page's end to its beginning: the text passed last is the nearest behind a mark; texts go before marks at one place.
    back = Window.partitionBy(key, "detector").orderBy(F.col("place").desc(), F.col("within").isNull().desc(), F.col("shown").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = F.last(F.when(F.col("within").isNull(), F.struct("place", "shown")), ignorenulls=True).over(back)
    near = found.withColumn("next", next_).where(F.col("next.place") <= F.col("place") + F.col("within")).select(key, "detector", F.col("next.shown").alias("value"))
    avatars = pages.select(key, F.lit("avatar asset").alias("detector"), F.explode(F.regexp_extract_all("html", F.lit(AVATAR), 1)).alias("value"))
    return near.union(avatars).distinct()


def unlisted(pages: DataFrame, allowed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, detector and value of what pages show or link to and ``allowed`` (value) lacks; case does not count."""
    known = allowed.select(F.lower(F.trim("value")).alias("__rf_v")).distinct()
    shown = displayed(pages, key=key)
    shown = shown.join(known, F.lower(F.trim("value")) == F.col("__rf_v"), "leftanti")
    return redact.unlisted(pages, allowed, key=key).union(shown)


# What every hit of a class contains, in patterns that are quickly searched: a view without it is not searched in full.
_HINTS = {"email": "@", "phone": r"[0-9][-. ][0-9]{4}", "street": r"[0-9]\s+[A-Z]"}


def class_hits(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and class of what must never be published, in any view of a page: as it stands, decoded, rendered, percent-decoded."""
    kind = pages.schema[key].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {name: (re.compile(_HINTS.get(name, "")), regex.compile(p.replace(r"\pL", r"\p{L}"))) for name, p in markup.CLASSES.items()}
        for batch in batches:
            ids, classes = [], []
            for k, page in enumerate(batch.column(column).to_pylist()):
                seen = dict.fromkeys(redact.views(page or ""))
                for name, (hint, pattern) in patterns.items():
                    if any(hint.search(view) and pattern.search(view) for view in seen):
                        ids.append(k)
                        classes.append(name)
            yield pa.record_batch([batch.column(key).take(pa.array(ids, pa.int64())), pa.array(classes, pa.string())], names=[key, "class"])

    return pages.select(key, column).mapInArrow(sweep, f"`{key}` {kind}, class string")


def page_skeletons(pages: DataFrame, stand_ins: list[str]) -> DataFrame:
    """page_id, skeleton (what a vocabulary must have) and own (that of the value with its angle brackets as they are; null without any) of each atom of the pages."""
    bare, value = F.translate("value", "<>", "  "), F.col("value")
    return markup.atoms(pages).select("page_id", markup.skeleton(bare, stand_ins).alias("skeleton"), markup.skeleton(F.when(value.rlike("[<>]"), value), stand_ins).alias("own"))


def publication_check(pages: DataFrame, stand_ins: list[str], vocabulary: DataFrame, survivors: DataFrame, skeletons: DataFrame | None = None) -> DataFrame:
    """page_id, stage and detail of what refuses each redacted page; pages without a row may be published.

    In order: a session's credential, an atom whose skeleton is not in ``vocabulary`` (skeleton), a class that must
    never be published in any view, a forbidden value (``survivors`` of the pages), an identity that is shown
    and no stand-in. A page shows its first stage only. ``skeletons``: those of the pages (``page_skeletons``), where they are there already.
    """
    credentials = markup.session_credentials(pages).select("page_id", F.lit(1).alias("stage"), F.col("signal").alias("detail"))
    skeletons = page_skeletons(pages, stand_ins) if skeletons is None else skeletons
    unknown = markup.off_vocabulary(skeletons.select("page_id", "skeleton"), vocabulary).select("page_id", F.lit(2).alias("stage"), F.col("skeleton").alias("detail"))
    classes = class_hits(pages).select("page_id", F.lit(3).alias("stage"), F.col("class").alias("detail"))
    left = survivors.select("page_id", F.lit(4).alias("stage"), F.col("value").alias("detail"))
    allowed = pages.sparkSession.createDataFrame([(s,) for s in stand_ins], "value string")
    shown = unlisted(pages, allowed).select("page_id", F.lit(5).alias("stage"), F.col("value").alias("detail"))
    every = credentials.union(unknown).union(classes).union(left).union(shown)
    every = every.withColumn("__rf_first", F.min("stage").over(Window.partitionBy("page_id"))).where("stage = __rf_first").distinct()
    names = F.array(*map(F.lit, ("credential", "vocabulary", "class", "forbidden", "shown")))
    return every.select("page_id", F.element_at(names, F.col("stage")).alias("stage"), "detail")


def captured(pages: DataFrame, substitutions: dict[str, str], note: str) -> DataFrame:
    """Pages (page_id, url, html, fetched_at, http_status) as fixtures: html and source_url redacted, with what is known of where they come from.

    A fixture is published only if ``publication_check`` has no row for it. Null pages are no fixtures.
    """
    made = pages.where("html IS NOT NULL").withColumn("bytes_before", F.octet_length("html"))
    made = redact.redacted(redact.redacted(made, substitutions), substitutions, column="url")
    return made.select("page_id", "html", F.col("url").alias("source_url"), "fetched_at", "http_status", F.lit(True).alias("redacted"), "bytes_before", F.octet_length("html").alias("bytes_after"), F.lit(note).alias("note"))
