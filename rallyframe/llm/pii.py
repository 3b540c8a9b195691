"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, digits, plus signs, schemes and
identifier cues. From each anchor a deterministic local parser expands to the boundaries of the
item and validates it; a parser never goes back behind the end of its kind's last item.

Base kinds (offsets in code points, end exclusive; leftmost, not overlapping within a kind):

* email: local part, at-sign, dotted host.
* ip: four dotted numbers; a part over 255 drops the item.
* card: digits, each pair apart by a blank, a hyphen or nothing; 16 to 19 digits that pass Luhn's test.
* phone: a plus sign, then digits with blanks, brackets, dots, hyphens; 8 to 15 digits.

Added kinds: url (scheme with a host, up to white space or a quote), secret (a cue such as
``token``, ``=`` or ``:``, and a value of 16 or more identifier characters), iban (two capitals, two
digits and 11 to 30 capitals or digits that pass the mod-97 test).

Null texts count as empty and have no items. Every whole text is read, a very long one as one string of one
task. A null doc_id stays null, and each of several rows of one doc_id has its own row, in order of nothing.
Extra columns are kept or ignored as told. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import small, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
MASKS = {k: f"<{k}>" for k in KINDS if k != "url"}

_local = re.compile(r"[A-Za-z0-9._%+-]+$")
_host = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_url = re.compile(r"[a-z]+://[^\s<>\"']+")
_secret = re.compile(r"\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{16,})")
_iban = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_machine: list[ahocorasick.Automaton] = []


def _anchors() -> ahocorasick.Automaton:
    if not _machine:
        a = ahocorasick.Automaton()
        for c in ("@", "+", *"0123456789"):
            a.add_word(c, (c if c in "@+" else "0", 1))
        for s in ("http://", "https://", "ftp://"):
            a.add_word(s, ("u", len(s)))
        for c in CUES:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, ("k", len(form)))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all items, by kind as listed in ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    last = dict.fromkeys(KINDS, 0)
    n = len(text)
    digits_end = 0  # end of the run of digits that has been looked at
    for at, (what, size) in _anchors().iter(text):
        if what == "@":
            start = at
            while start > last["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _host.match(text, at + 1)):
                last["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "0":
            if at < digits_end:
                continue
            end = at + 1
            while end < n and text[end] in _DIGITS:
                end += 1
            digits_end = end
            if end < n and text[end] == "." and end > last["ip"]:
                start = max(at, last["ip"])
                if m := _ip.match(text, start):
                    last["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
            if end > last["card"]:
                start = max(at, last["card"])
                if m := _card.match(text, start):
                    last["card"] = m.end()
                    digits = [c for c in m[0] if c in _DIGITS]
                    if 16 <= len(digits) <= 19 and luhn("".join(digits)):
                        found["card"].append(m.span())
            if end - at >= 2 and at >= 2 and at - 2 >= last["iban"] and (at < 3 or not text[at - 3].isalnum()) and (m := _iban.match(text, at - 2)) and _mod97(m[0]):
                last["iban"] = m.end()
                found["iban"].append(m.span())
        elif what == "+":
            if at >= last["phone"] and (m := _phone.match(text, at)):
                last["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "u":
            start = at - size + 1
            if start >= last["url"] and (m := _url.match(text, start)) and m.end() > at + 1:
                last["url"] = m.end()
                found["url"].append(m.span())
        elif at >= last["secret"] and (m := _secret.match(text, at + 1)):
            last["secret"] = m.end()
            found["secret"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def masked(text: str | None) -> str | None:
    """The text with every item but plain URLs replaced by its kind in angle brackets; overlapping items become one, named by the first."""
    items = sorted((x for x in find(text) if x[0] in MASKS), key=lambda x: (x[1], -x[2]))
    if not items:
        return text
    out, end = [], 0
    for kind, s, e in items:
        if s >= end:
            out += [text[end:s], MASKS[kind]]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the count of each base kind, base_sha256 and spans (``kind:start:end``, comma-joined)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, hashes, spans = {k: [] for k in BASE_KINDS}, [], []
            for text in batch.column("text"):
                items = find(text.as_py())
                for k in BASE_KINDS:
                    counts[k].append(sum(i[0] == k for i in items))
                said = [f"{k}:{s}:{e}" for k, s, e in items]
                base = sum(counts[k][-1] for k in BASE_KINDS)
                hashes.append(hashlib.sha256(",".join(said[:base]).encode()).hexdigest())
                spans.append(",".join(said))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the items in ``text`` masked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array([masked(x.as_py()) for x in batch.column(k)], batch.schema.field(k).type))

    return docs.mapInArrow(scan, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
