"""Saved pages as a source: HTML tables read by column expressions, one row for each table row.

A page whose table is missing, or whose table has other columns, gives one row with an ``error``; it is
never silently empty. A missing optional value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headers of the saved pages, lower case without blanks, in the pages' order.
MATCH_HISTORY = ["matchdate", "league", "team", "court", "partner", "opponent(s)", "w/l", "result", "match", "rating"]
SCHEDULE = ["localschedule", "time", "opponent", "matchsite", "result"]
BLANKS = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"  # Unicode's white space


def read_pages(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """Whole files as (url, html); the file's own name where no source URL is declared."""
    return spark.read.text(path, wholetext=True).select(F.coalesce(F.lit(url), F.input_file_name()).alias("url"), F.col("value").alias("html"))


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with the declared columns only; refuses one that is missing, or whose columns are missing or of other types."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise ValueError(f"{path} does not exist")
    wanted, found = T.StructType.fromDDL(schema), spark.read.parquet(path)
    has = dict(found.dtypes)
    wrong = [f"{f.name} is {has.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in wanted.fields if has.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return found.select([f.name for f in wanted.fields])


def archived(pages: DataFrame, path: str, fetched_at: str) -> DataFrame:
    """Raw pages (url, html, http_status) written with their provenance to a new folder and read from there: parsers see only what is on file. An existing folder is refused."""
    kept = pages.select("url", F.lit(fetched_at).cast("timestamp").alias("fetched_at"), "http_status", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"), "html")
    kept.write.mode("errorifexists").parquet(path)
    return pages.sparkSession.read.schema(kept.schema).parquet(path)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def cell_text(html: Column) -> Column:
    """Text of a cell: line breaks as ``|``, tags dropped, the common entities decoded, white space collapsed."""
    t = F.when(html.contains("<"), F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "|"), "<[^>]*>", "")).otherwise(html)
    return collapse(F.when(html.contains("&"), _decoded(t)).otherwise(t))


def _decoded(t: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def _header(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: F.regexp_replace(F.lower(cell_text(c)), r"[\s|]+", ""))


def rows_of(page: Column, columns: list[str]) -> Column:
    """The raw rows, header first, of the first table of a page that has these columns; null without one."""
    tables = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1), lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1))
    wanted = F.array(*map(F.lit, columns))
    return F.get(F.filter(tables, lambda rows: (F.size(rows) > 0) & (_header(F.get(rows, 0)) == wanted)), 0)


def table_rows(pages: DataFrame, columns: list[str]) -> DataFrame:
    """url, place, cells (raw HTML of each cell) and error of the rows of the first table that has these columns.

    A page is read once: one without the table goes on as one null row.
    """
    found = pages.select("url", rows_of(F.col("html"), columns).alias("rows"))
    body = F.when(F.col("rows").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))))
    return row_cells(found.select("url", F.posexplode(body).alias("place", "row")), columns)


def row_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (place, row and more) with cells and error for row; a null row is a page without the table and has no place."""
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
    rows = rows.withColumn("place", F.when(F.col("row").isNotNull(), F.col("place"))).withColumn("cells", cells).drop("row")
    odd = F.when(F.size("cells") != len(columns), F.concat(F.lit("row has "), F.size("cells").cast("string"), F.lit(f" cells, expected {len(columns)}")))
    return rows.withColumn("error", F.when(F.col("cells").isNull(), "table not found").otherwise(odd))


def us_date(text: Column) -> Column:
    """M/D/YYYY as YYYY-MM-DD text, without a calendar check; anything else is null."""
    shape = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    part = [F.regexp_extract(text, shape, k) for k in (1, 2, 3)]
    return F.when(part[2] != "", F.concat_ws("-", part[2], F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0")))


def number(text: Column) -> Column:
    """A number in optional brackets, else null."""
    return F.regexp_replace(text, r"[()\s]", "").try_cast("double")


def discipline(slot: Column) -> Column:
    """By the slot's letter, before a number and an X or nothing; else null."""
    shaped = F.upper(slot).rlike("^.[0-9]+X?$")
    return F.when(shaped & (F.upper(F.substring(slot, 1, 1)) == "S"), "singles").when(shaped & (F.upper(F.substring(slot, 1, 1)) == "D"), "doubles")


def match_history(pages: DataFrame) -> DataFrame:
    """One row for each court of the desktop table; a row that breaks a rule has its error and no other promise."""
    return history_rows(table_rows(pages, MATCH_HISTORY))


def history_rows(rows: DataFrame) -> DataFrame:
    """The courts in ``rows`` (place, cells and error; other columns are kept); each cell is read once."""
    others = [c for c in rows.columns if c not in ("place", "cells", "error")]
    def cell(k: int) -> Column:
        return F.get("texts", k)

    def parts(k: int) -> Column:
        return F.filter(F.transform(F.split(cell(k), r"\|"), lambda x: F.trim(x)), lambda x: x != "")

    rows = rows.select(*others, "place", F.transform("cells", cell_text).alias("texts"), F.get("cells", 7).alias("link"), "error")
    rows = rows.select(*others, "place", "texts", "link", "error", parts(1).alias("league"), parts(4).alias("with"), parts(5).alias("against"))
    # One struct, taken apart again: what is asked of the rows later is not pushed below, where each of its parts would read the cells anew.
    read = F.struct("texts", "link", "error", "league", "with", "against", rated(F.col("against")).alias("rated"))
    rows = rows.select(*others, "place", F.inline(F.array(read)))
    rows = rows.select(
        *others, "place", us_date(cell(0)).alias("played_on"), F.array_join("league", " ").alias("league_context"), F.get(parts(2), 0).alias("team_name"), cell(3).alias("slot"), discipline(cell(3)).alias("discipline"),
        (F.get("league", 0) == "Tournament").alias("tournament"), F.get("with", 0).alias("partner"), F.get(rated(F.col("with")), 0)["rating"].alias("partner_rating"), F.exists("against", lambda x: F.lower(x).startswith("default")).alias("defaulted"),
        F.transform("rated", lambda x: x["name"]).alias("opponents"), F.transform("rated", lambda x: x["rating"]).alias("opponent_ratings"),
        F.when(F.upper(cell(6)).isin("W", "L"), F.upper(cell(6))).alias("result"), sets(parts(7)).alias("sets"), F.regexp_extract("link", r"[?&;]mid=([^&\"'#]+)", 1).alias("source_match_id"),
        number(cell(8)).alias("match_rating"), (F.upper(cell(8)) == "S").alias("self_rated"), number(cell(9)).alias("resulting_rating"), "error",
    )
    want = F.when(F.col("discipline") == "singles", 1).otherwise(2)
    checks = [
        (F.col("played_on").isNull(), "unparseable date"), (F.col("league_context") == "", "no league"), (F.col("team_name").isNull(), "no team"), (F.col("discipline").isNull(), "unknown slot"),
        (F.col("result").isNull(), "unknown result"), (F.col("source_match_id") == "", "no match id"), (~F.col("defaulted") & (F.size("opponents") != want), "wrong number of opponents"),
        (~F.col("defaulted") & (F.col("discipline") == "doubles") & F.col("partner").isNull(), "no partner"),
    ]
    return rows.withColumn("error", F.coalesce("error", *[F.when(c, F.lit(m)) for c, m in checks]))


def rated(lines: Column) -> Column:
    """(name, rating) of each player: a line in brackets with a number is the rating of the name before it; lines of a default name nobody."""
    is_rating = lambda x: x.startswith("(") & x.endswith(")") & number(x).isNotNull()
    each = F.transform(lines, lambda x, i: F.when(~is_rating(x) & ~F.lower(x).startswith("default"), F.struct(x.alias("name"), F.when(is_rating(F.get(lines, i + 1)), number(F.get(lines, i + 1))).alias("rating"))))
    return F.filter(each, lambda p: p.isNotNull())


def sets(lines: Column) -> Column:
    """Winner-first games of each set; a third or later set with no side above 1 is a match tiebreak."""
    scored = F.filter(lines, lambda x: x.rlike(r"^\d+-\d+"))

    def one(x: Column, i: Column) -> Column:
        a, b = F.regexp_extract(x, r"^(\d+)-(\d+)", 1).cast("int"), F.regexp_extract(x, r"^(\d+)-(\d+)", 2).cast("int")
        return F.struct(a.alias("winner"), b.alias("loser"), ((i >= 2) & (F.greatest(a, b) <= 1)).alias("match_tiebreak"))

    return F.transform(scored, one)


def schedule(pages: DataFrame) -> DataFrame:
    """Rows of a team page's schedule."""
    rows = table_rows(pages, SCHEDULE)
    names = ["played_on", "time", "opponent", "site", "result"]
    out = rows.select("url", "place", *[cell_text(F.get("cells", k)).alias(n) for k, n in enumerate(names)], "error")
    return out.withColumn("played_on", us_date(F.col("played_on")))
