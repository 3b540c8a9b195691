"""Queries of redaction, skeletons, classes, credentials and atoms of pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.functions import markup, publication, redact
from rallyframe.plans import bind
from rallyframe.plans.registry import query
from rallyframe.sources.store import written


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The SQL of this module states its patterns by hand; none is taken from the code under test.
_CLASS_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}",
    "mailto": r"(?i)mailto:[^\s<>()\"'\[\]|\\]+",
    "phone": r"(?:\([0-9]{3}\)(?: [-.]?|[-.]?)|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
    "street": r"\b[0-9]{1,6}\s+(?:[A-Z][A-Za-z]+\s+)+?(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Court|Ct|Way|Terrace|Ter)\b",
    "tel": r"(?i)tel:[+]?[0-9()\-. ]{7,}[0-9]",
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS class, regexp_extract(text, {_sql_text(p)}, 0) AS hit FROM documents WHERE regexp_matches(text, {_sql_text(p)})" for k, p in _CLASS_SQL.items()), base=False)
def pii_classes(s, d):
    return markup.first_hits(bind.read(s, d, "documents"))


def _sql_skeleton(text: str) -> str:
    """Days, scores, path data, colours and numbers out, by hand, then all but letters and digits."""
    runs = (r"\b[0-9][0-9]?[-/][0-9][0-9]?[-/][0-9]{2,4}\b", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]+[.][0-9]+\b", r"[0-9][0-9]?-[0-9][0-9]?(?:\s?[(][0-9][0-9]?(?:-[0-9][0-9]?)?[)])?",
            r"#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b", r"[mlhvcsqtazMLHVCSQTAZ](?:\s*-?[0-9]+(?:[.][0-9]+)?[\s,]*)+", r"\b[0-9]+\b")
    for p in runs:
        text = f"regexp_replace({text}, {_sql_text(p)}, ' ', 'g')"
    return rf"trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_sql_skeleton('text')}) AS skeleton FROM documents", base=False)
def skeletons(s, d):
    return bind.read(s, d, "documents").select("doc_id", F.md5(markup.skeleton(F.col("text"))).alias("skeleton"))


_LINES = f"(SELECT conv_id, turn, {_sql_skeleton('text')} AS skeleton FROM conversations)"


@query(f"SELECT conv_id, turn, skeleton FROM {_LINES} a WHERE skeleton <> '' AND skeleton NOT IN (SELECT skeleton FROM {_LINES} b WHERE conv_id % 2 = 0)", base=False)
def off_vocabulary(s, d):
    lines = bind.read(s, d, "conversations").select("conv_id", "turn", markup.skeleton(F.col("text")).alias("skeleton"))
    return markup.off_vocabulary(lines, lines.where("conv_id % 2 = 0")).select("conv_id", "turn", "skeleton")


@query(rf"SELECT DISTINCT skeleton, regexp_matches(skeleton, '(^|[^\p{{L}}])\p{{L}}+ \p{{L}}') OR regexp_matches(skeleton, '\p{{L}} \p{{L}}') AS review FROM {_LINES} a WHERE skeleton <> ''", base=False)
def vocabulary_bootstrap(s, d):
    """Distinct skeletons of the turns, and whether they are name-shaped and need a review."""
    lines = bind.read(s, d, "conversations").select(markup.skeleton(F.col("text")).alias("skeleton")).where("skeleton <> ''").distinct()
    return lines.select("skeleton", markup.needs_review(F.col("skeleton")).alias("review"))


# What is added to a third of the pages each: one name in mixed spellings, and what it must become.
VALUES = {"Holloway, Jun": "Kestrel, Avery", "example.net": "club.invalid", "Jun": "Avery"}
ADDED = (
    ("<a href='?n=Holloway%2c Jun'>HOLLOWAY, JUN</a>", "<a href='?n=Kestrel%2c Avery'>KESTREL, AVERY</a>"),
    ("<p>&#72;olloway,&#x20;Jun &#74un holloway%2C+jun Junction</p>", "<p>Kestrel,&#x20;Avery Avery Kestrel%2C+Avery Averyction</p>"),
    ("<p>Holloway,\n  J&#8203;un EXAMPLE&period;NET</p>", "<p>Kestrel,\n  Avery CLUB&period;INVALID</p>"),
)
_STRIPPED = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<script></script>', 'g'), '(?is)<style[^>]*>.*?</style>', '<style></style>', 'g')"


def _choice(parts, column: str = "page_id") -> str:
    return f"list_extract([{', '.join(map(_sql_text, parts))}], CAST({column} % {len(parts)} AS INTEGER) + 1)"


def _pages_with(s, d, parts):
    """The pages with one of the parts each, dealt out by their ids: a file's few row groups would leave most cores idle. The number keeps the tasks small."""
    return bind.read(s, d, "pages").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page_id").withColumn("html", F.concat("html", F.get(F.array(*map(F.lit, parts)), F.col("page_id") % len(parts))))


@query(rf"SELECT page_id, md5(regexp_replace(regexp_replace({_STRIPPED}, 'EXAMPLE\.NET', 'CLUB.INVALID', 'g'), '(?i)example\.net', 'club.invalid', 'g') || {_choice([p[1] for p in ADDED])}) AS digest FROM pages", base=False)
def redacted_pages(s, d):
    return redact.redacted(_pages_with(s, d, [p[0] for p in ADDED]), VALUES).select("page_id", F.md5("html").alias("digest"))


# What each view of the three additions shows of the name.
_SHOWN = {0: {"raw": 2, "decoded": 2, "rendered": 2, "percent": 2}, 1: {"raw": 2, "decoded": 2, "rendered": 2, "percent": 2}, 2: {"raw": 1, "decoded": 1, "percent": 1}}


@query(" UNION ALL ".join(f"SELECT page_id, 'Holloway, Jun' AS value, '{v}' AS view, CAST({n} AS BIGINT) AS n FROM pages WHERE page_id % 3 = {k}" for k, shown in _SHOWN.items() for v, n in shown.items()), base=False)
def forbidden_survivors(s, d):
    """What a sweep for the name finds before redaction. (A rendered zero-width character is a blank, so it parts the name there.)"""
    return redact.survivors(_pages_with(s, d, [p[0] for p in ADDED]), ["Holloway, Jun"])


@query("SELECT page_id, 'Holloway, Jun' AS value, 'raw' AS view, CAST(0 AS BIGINT) AS n FROM pages WHERE false", base=False)
def redaction_leaks(s, d):
    """The same sweep after redaction finds nothing."""
    return redact.survivors(redact.redacted(_pages_with(s, d, [p[0] for p in ADDED]), VALUES), ["Holloway, Jun"])


_TOKEN = "Ab9+/" * 13
CREDENTIALS = (
    ("<input type='hidden' name='__VIEWSTATE' value='x1'><input type='submit' name='csrf' value='Go'>", ("name",)),
    (f"<meta name='state' content='{_TOKEN}'><meta http-equiv='origin-trial' content='{_TOKEN}'>", ("shape",)),
    ("<INPUT TYPE=hidden ID=left VALUE=7><input type=hidden name=page value=''>", ("hidden",)),
    ("<input type='text' name='q' value='some words'><meta name='author' content='me'>", ()),
)


@query(" UNION ALL ".join(f"SELECT page_id, '{x}' AS signal FROM pages WHERE page_id % {len(CREDENTIALS)} = {k}" for k, (_, said) in enumerate(CREDENTIALS) for x in said), base=False)
def session_credentials(s, d):
    return markup.session_credentials(_pages_with(s, d, [c[0] for c in CREDENTIALS])).select("page_id", "signal")


ATOMS = (
    ("<td colspan='2' title=\"Jo Day\" Width=10%>x <!-- by Al --></td>", (("attribute", "title", "Jo Day"), ("text", None, "x"), ("comment", None, "by Al"))),
    ("<svg viewBox='0 0 4 4' fill=#fff stroke='url(x)'><path d='M0 0L4 4z' 9x='1'/></svg>", (("attribute", "stroke", "url(x)"), ("attribute", "9x", "1"), ("attribute-name", None, "9x"))),
)


@query(
    " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, {'NULL' if n is None else _sql_text(n)} AS name, {_sql_text(v)} AS value, CAST(1 AS BIGINT) AS n FROM pages WHERE page_id % {len(ATOMS)} = {i}" for i, (_, atoms) in enumerate(ATOMS) for k, n, v in atoms),
    base=False,
)
def added_atoms(s, d):
    """The atoms that two additions bring to a page beyond its own."""
    own, more = markup.page_atoms(bind.read(s, d, "pages")), markup.page_atoms(_pages_with(s, d, [a[0] for a in ATOMS]))
    before = own.select("page_id", "kind", F.coalesce("name", F.lit("")).alias("key"), "value", F.col("n").alias("had"))
    joined = more.withColumn("key", F.coalesce("name", F.lit(""))).join(before, ["page_id", "kind", "key", "value"], "left").withColumn("n", F.col("n") - F.coalesce("had", F.lit(0)))
    return joined.where("n > 0").select("page_id", "kind", "name", "value", "n")


@query(
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '<script></script>', 'g'), '(?s)<style[^>]*>.*?</style>', '<style></style>', 'g') AS html FROM pages),
bare AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g') AS html FROM h),
tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][^>]*>')) AS tag FROM bare),
pairs AS (SELECT page_id, unnest(regexp_extract_all(tag, '[a-z]+="[^"]*"')) AS pair FROM tags),
atoms AS (SELECT page_id, 'text' AS kind, CAST(NULL AS VARCHAR) AS name, trim(unnest(string_split_regex(html, '<[^>]*>'))) AS value FROM bare
  UNION ALL SELECT page_id, 'comment', NULL, trim(unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1))) FROM h
  UNION ALL SELECT page_id, 'attribute', split_part(pair, '=', 1), trim(split_part(pair, '"', 2)) FROM pairs)
SELECT page_id, kind, name, value, count(*) AS n FROM atoms WHERE value <> '' GROUP BY 1, 2, 3, 4""",
    base=False,
)
def page_atoms(s, d):
    """The atoms of the pages without bodies of scripts and styles. (The SQL reads tags as the pages have them: complete, with quoted values.)"""
    return markup.page_atoms(bind.read(s, d, "pages").withColumn("html", markup.strip_code(F.col("html"))))


def _broken(page: str, title: str) -> str:
    """SQL and Spark alike: a page cut inside its last tag, with its title before the first tag, in a doctype, behind the last tag and in an open comment."""
    return f"concat('{page} ', {title}, '<!DOCTYPE x \"', {title}, '\">', html, {title}, '<{page}-x>', '<!-- ', {title})"


@query(
    rf"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)
SELECT page_id, kind, value FROM (SELECT page_id, 'directive' AS kind, 'DOCTYPE x "' || t || '"' AS value FROM t UNION ALL SELECT page_id, 'text', trim('page ' || t) FROM t
UNION ALL SELECT page_id, 'element-name', 'page-x' FROM t UNION ALL SELECT page_id, 'unfinished', trim('<!-- ' || t) FROM t)""",
    base=False,
)
def broken_page_atoms(s, d):
    """What pages say outside their tags: each page with its own title put before, behind, in a doctype and in a comment that never ends."""
    pages = bind.read(s, d, "pages").withColumn("__t", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    pages = pages.select("page_id", F.expr(_broken("page", "__t")).alias("html"))
    return markup.page_atoms(pages).where("kind IN ('directive', 'element-name', 'unfinished') OR value LIKE 'page %'").select("page_id", "kind", "value")


_PROFILE = """concat('<section class="x playerDetailsHeader_', page_id, '">', substr(html, 1, CAST(page_id * 37 % 420 AS INT)), '<h2 class=n>', 'W ', page_id, '</h2></section><p data-element-name="fullName">',
 repeat('y', CAST(page_id * 53 % 800 AS INT)), '<h3>', regexp_extract(html, '<a href="/([^"<]*)"', 1), '</h3><i data-element-name="nameGenderAddress"><span>F</span> | City ', page_id, ' <br>',
 '<img src="/User/01234567-89ab-cdef-0123-', lpad(CAST(page_id AS STRING), 12, '0'), '/p.png">')"""


@query(
    r"""WITH p AS (SELECT page_id, """ + _PROFILE.replace("AS STRING", "AS VARCHAR") + r""" AS html FROM pages)
SELECT DISTINCT * FROM (SELECT page_id, 'displayed name' AS detector, unnest(regexp_extract_all(html, 'data-element-name="fullName"[\s\S]{0,400}?<h3[^>]*>([^<]+)</h3>', 1)) AS value FROM p
UNION ALL SELECT page_id, 'displayed location', unnest(regexp_extract_all(html, 'data-element-name="nameGenderAddress"[\s\S]{0,400}?</span>\s*[|]\s*([^<|]+?)\s*<br', 1)) FROM p
UNION ALL SELECT page_id, 'displayed profile', unnest(regexp_extract_all(html, 'class="[^"]*playerDetailsHeader[^"]*"[\s\S]{0,200}?<h2[^>]*>([^<]+)</h2>', 1)) FROM p
UNION ALL SELECT page_id, 'avatar asset', unnest(regexp_extract_all(html, '(?i)/User/([0-9a-f-]{36})/', 1)) FROM p)""",
    base=False,
)
def displayed_identities(s, d):
    """Names, places and pictures that pages show near a mark, which no list has to know: profiles made of the pages, their texts at distances within and beyond reach."""
    pages = bind.read(s, d, "pages").select("page_id", F.expr(_PROFILE).alias("html"))
    return publication.displayed(pages)


@query()
def publication_check(s, d):
    """Redacted pages against the vocabulary of the pages with even ids. Redacted pages and their skeletons are made once and written."""
    pages = written(redact.redacted(_pages_with(s, d, [p[0] for p in ADDED]), VALUES).select("page_id", "html"), "redacted")
    stand_ins = ["Kestrel, Avery"]
    skeletons = written(publication.page_skeletons(pages, stand_ins), "skeletons")
    known = skeletons.where("page_id % 2 = 0").select(F.coalesce("own", "skeleton").alias("skeleton"))
    return publication.publication_check(pages, stand_ins, known, redact.survivors(pages, list(VALUES)), skeletons)


@query("SELECT page_id, 'playername' AS detector, 'jo day ' || page_id AS value FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'tennis-id', 'B7' FROM pages WHERE page_id % 3 = 2", base=False)
def unlisted_identities(s, d):
    """Names in links that the list of stand-ins lacks, in form encoding and any case."""
    k = F.col("page_id")
    said = F.when(k % 3 == 0, F.concat(F.lit("<a href='?a=1&amp;playername=jo+day%20"), k.cast("string"), F.lit("'>x</a>"))).when(k % 3 == 1, "<a href=\"?playername=AVERY%20kestrel\">x</a>").otherwise("<a href=\"?tennis-id=B7\">x</a>")
    pages = bind.read(s, d, "pages").select("page_id", said.alias("html"))
    return redact.unlisted(pages, pages.sparkSession.range(1).select(F.lit("Avery Kestrel").alias("value")))


@query(
    rf"""WITH p AS (SELECT page_id, url, html, regexp_replace(regexp_replace({_STRIPPED}, 'EXAMPLE\.NET', 'CLUB.INVALID', 'g'), '(?i)example\.net', 'club.invalid', 'g') AS made FROM pages)
SELECT page_id, regexp_replace(regexp_replace(url, 'EXAMPLE\.NET', 'CLUB.INVALID', 'g'), '(?i)example\.net', 'club.invalid', 'g') AS source_url, CAST(200 + page_id % 2 AS INTEGER) AS http_status, true AS redacted, CAST(strlen(html) AS INTEGER) AS bytes_before, CAST(strlen(made) AS INTEGER) AS bytes_after, 'from the tables' AS note, md5(made) AS digest FROM p""",
    base=False,
)
def captures(s, d):
    """Fixtures made of the pages: redacted page and address, and their provenance."""
    pages = bind.read(s, d, "pages").withColumn("fetched_at", F.lit("2026-05-01")).withColumn("http_status", (200 + F.col("page_id") % 2).cast("int"))
    made = publication.captured(pages, VALUES, "from the tables")
    return made.select("page_id", "source_url", "http_status", "redacted", "bytes_before", "bytes_after", "note", F.md5("html").alias("digest"))
