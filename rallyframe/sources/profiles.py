"""Player and team pages as sources, by the same rules as the other page tables.

A missing block that the page must have gives a row with an ``error``; a missing optional value is
null. Tables inside tables are not looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.grammar import win_loss
from rallyframe.sources.tables import cell_text, number, table_rows, us_date

# Labels, headers (lower case without blanks) and rating letters of the saved pages.
DYNAMIC = "Estimated Dynamic Rating"
PROJECTED = "Projected Year End Rating"
AREAS = "Current Playing Areas (Player Rating Lists)"
LEAGUES = ("Adult", "Mixed", "Senior", "Tri-Level", "Combo")
RATING_TYPES = ("C", "S", "A", "D", "M", "T", "B", "E", "P")
RECENT_TEAMS = ["recentteam", "type", "section", "gender", "rating", "matchstart"]
SEASONS = ["allmatches", "totalmatches", "win", "loss", "wpct", "totalsets", "win", "loss", "wpct", "totalgames", "win", "loss", "wpct", "defaults"]
ROSTER = ["name", "location", "ntrp", "seasonrecord", "localsingles", "localdoubles", "localrecord", "rating"]
ROSTER_OPTIONAL = ["postseasonsingles", "postseasondoubles", "postseasonrecord"]


def _tables(html: Column | str) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)


def _rows(table: Column) -> Column:
    return F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1)


def _lines(cell: Column) -> Column:
    return F.filter(F.transform(F.split(cell_text(cell), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def _has(row: Column, label: str) -> Column:
    return F.exists(_cells(row), lambda c: cell_text(c) == label)


def _observation(lines: Column) -> Column:
    value, day = number(F.get(lines, 0)), us_date(F.get(lines, 1))
    return F.when(value.isNotNull() & day.isNotNull(), F.struct(value.alias("value"), day.alias("observed_on")))


def player_header(pages: DataFrame) -> DataFrame:
    """One row for each page: url, name, location, gender, ntrp (value, rating_type, observed_on), dynamic_rating (value, observed_on), projected_rating, error."""
    p = pages.select("url", F.transform(_tables("html"), _rows).alias("tables"))
    p = p.withColumn("block", F.get(F.filter("tables", lambda rows: F.exists(rows, lambda r: _has(r, DYNAMIC))), 0))
    p = p.withColumn("top", _cells(F.get("block", 0))).withColumn("dynamic", _lines(F.get(_cells(F.get(F.filter("block", lambda r: _has(r, DYNAMIC)), 0)), 1)))
    p = p.withColumn("projected", _lines(F.get(_cells(F.get(F.filter(F.flatten("tables"), lambda r: _has(r, PROJECTED)), 0)), 1)))
    p = p.withColumn("who", _lines(F.get("top", 0))).withColumn("level", _lines(F.get("top", 1)))
    # ``Name (Place)``: split at the first bracket if the line ends in its only closing one.
    first = F.trim(F.get("who", 0))
    inner = F.substr(first, F.length(F.substring_index(first, "(", 1)) + 2)
    placed = first.contains("(") & (F.locate(")", inner) == F.length(inner)) & (inner != "")
    name, location = F.when(placed, F.trim(F.substring_index(first, "(", 1))).otherwise(first), F.when(placed, F.substring_index(inner, ")", 1))
    # ``4.0 C``: a level in halves, and a letter behind it or none.
    words = F.split(F.get("level", 0), " +")
    number_, second = F.get(words, 0), F.get(words, 1)
    halves = number_.try_cast("double") * 2
    shaped = F.char_length(number_).isin(1, 3) & number_.rlike("^[0-9]") & (halves == F.floor(halves)) & (F.size(words) <= 2) & (second.isNull() | second.rlike("^[A-Za-z]$"))
    level, letter, day = F.when(shaped, halves / 2), F.upper(second), us_date(F.get("level", 1))
    known = level.isNotNull() & day.isNotNull()
    error = F.when(F.col("block").isNull(), "header not found").when(known & letter.isNotNull() & ~letter.isin(*RATING_TYPES), F.concat(F.lit("unknown rating type "), letter)).when(F.coalesce(name, F.lit("")) == "", "no name")
    return p.select(
        "url", name.alias("name"), location.alias("location"), F.when(F.get("who", 1).isin("Male", "Female"), F.get("who", 1)).alias("gender"),
        F.when(known, F.struct(level.alias("value"), letter.alias("rating_type"), day.alias("observed_on"))).alias("ntrp"), _observation(F.col("dynamic")).alias("dynamic_rating"), number(F.get("projected", 0)).alias("projected_rating"), error.alias("error"),
    )


def playing_areas(pages: DataFrame) -> DataFrame:
    """url, place and area; pages without the table have none."""
    rows = F.get(F.filter(F.transform(_tables("html"), _rows), lambda rows: F.exists(rows, lambda r: _has(r, AREAS))), 0)
    p = pages.select("url", rows.alias("rows")).select("url", F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).alias("place", "row"))
    return p.select("url", "place", F.replace(cell_text(F.col("row")), F.lit("|"), F.lit(" ")).alias("area")).where("area <> ''")


def recent_teams(pages: DataFrame) -> DataFrame:
    """url, place, team_name, league_type, section, gender, rating_level, match_start_on, error; pages without the table have none."""
    rows = table_rows(pages, RECENT_TEAMS).where("place IS NOT NULL")
    names = ["team_name", "league_type", "section", "gender", "rating_level", "match_start_on"]
    out = rows.select("url", "place", *[cell_text(F.get("cells", k)).alias(n) for k, n in enumerate(names)], "error").withColumn("match_start_on", us_date(F.col("match_start_on")))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("team_name") == "", "no team name")))


def season_records(pages: DataFrame) -> DataFrame:
    """url, place, year, counts (total, wins, losses) of matches, sets and games, defaults, error."""
    rows = table_rows(pages, SEASONS)

    def count(k: int) -> Column:
        return number(cell_text(F.get("cells", k))).cast("int")

    def counts(k: int) -> Column:
        return F.struct(count(k).alias("total"), count(k + 1).alias("wins"), count(k + 2).alias("losses"))

    year = cell_text(F.get("cells", 0))
    unread = F.lit(False)
    for k in (1, 2, 3, 5, 6, 7, 9, 10, 11, 13):
        unread = unread | count(k).isNull()
    error = F.coalesce("error", F.when(year == "", "no year").when(unread, "not a count"))
    return rows.select("url", "place", year.alias("year"), counts(1).alias("matches"), counts(5).alias("sets"), counts(9).alias("games"), count(13).alias("defaults"), error.alias("error"))


def team_header(pages: DataFrame) -> DataFrame:
    """url, team_name, season_name, league_type, section, gender, rating_level, error.

    The line of context ends in a gender letter and a level. Without an age band the league's name
    and its section can't be told apart: both stay in ``section``.
    """
    def begins(t: Column) -> Column:
        text = F.trim(cell_text(t))
        return reduce(lambda a, b: a | b, [text.startswith(n) for n in LEAGUES])

    p = pages.select("url", _rows(F.get(F.filter(_tables("html"), begins), 0)).alias("rows"))
    p = p.select("url", "rows", *[F.replace(cell_text(F.get("rows", k)), F.lit("|"), F.lit(" ")).alias(n) for k, n in enumerate(("context", "season", "team_name"))])
    # Words from the right: level, gender, section; an age band (digits and a plus sign) ends the league's name.
    p = p.withColumn("words", F.split(F.trim("context"), " +"))
    n = F.size("words")
    level, gender = F.get("words", n - 1), F.get("words", n - 2)
    shaped = (n >= 3) & (F.translate(level, "0123456789.", "") == "") & (F.char_length(gender) == 1) & gender.between("A", "Z")
    rest = F.slice("words", 1, F.greatest(n - 2, F.lit(1)))
    band = F.array_position(F.transform(rest, lambda w: w.endswith("+") & F.substring(w, -2, 1).between("0", "9")), True).cast("int")
    split = shaped & (band > 0) & (band < n - 2)
    section = F.when(split, F.slice("words", band + 1, F.greatest(n - 2 - band, F.lit(1)))).otherwise(rest)
    return p.select(
        "url", "team_name", F.nullif("season", F.lit("")).alias("season_name"), F.when(split, F.array_join(F.slice("words", 1, F.greatest(band, F.lit(1))), " ")).alias("league_type"), F.when(shaped, F.array_join(section, " ")).alias("section"),
        F.when(shaped, gender).alias("gender"), F.when(shaped, level).alias("rating_level"), F.when(F.col("rows").isNull(), "header not found").alias("error"),
    )


def team_roster(pages: DataFrame) -> DataFrame:
    """Rows of a team page's roster; columns are found by their headers, so optional ones may stand anywhere.

    A header that is unknown, given twice or missing is the error of the page; a row's cells must be
    as many as the headers' spans.
    """
    tables = F.transform(_tables("html"), _rows)
    opened = r"(?is)<t[hd]([^>]*)>(.*?)</t[hd]>"

    def heads(row: Column) -> Column:
        return F.transform(_cells(row), lambda c: F.regexp_replace(F.regexp_replace(F.lower(cell_text(c)), r"[\s|]+", ""), r"^\d{4}record$", "seasonrecord"))

    fits = F.filter(tables, lambda rows: (F.size(rows) > 0) & F.array_contains(heads(F.get(rows, 0)), "name") & F.array_contains(heads(F.get(rows, 0)), "ntrp"))
    p = pages.select("url", F.get(fits, 0).alias("rows"))
    p = p.withColumn("heads", heads(F.get("rows", 0)))
    spans = F.transform(F.regexp_extract_all(F.get("rows", 0), F.lit(opened), 1), lambda a: F.greatest(F.coalesce(F.regexp_extract(a, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1)), F.lit(1)))
    p = p.withColumn("spans", spans).withColumn("width", F.aggregate("spans", F.lit(0), lambda a, x: a + x))
    unknown = F.array_except("heads", F.array(*map(F.lit, ROSTER + ROSTER_OPTIONAL)))
    missing = F.array_except(F.array(*map(F.lit, ROSTER)), F.col("heads"))
    required = F.filter("heads", lambda h: h.isin(*ROSTER))
    error = F.when(F.col("rows").isNull(), "roster not found").when(F.size(unknown) > 0, F.concat(F.lit("unknown column "), F.get(unknown, 0)))
    error = error.when(F.size(F.array_distinct(required)) < F.size(required), "column given twice").when(F.size(missing) > 0, F.concat(F.lit("missing columns "), F.array_join(missing, ",")))
    p = p.withColumn("error", error)
    body = F.when(F.col("error").isNull(), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.array(F.lit(None).cast("string")))
    p = p.select("url", "heads", "spans", "width", "error", F.posexplode(body).alias("place", "row"))
    p = p.withColumn("place", F.when(F.col("error").isNull(), F.col("place"))).withColumn("cells", F.transform(_cells(F.col("row")), cell_text))

    def cell(name: str) -> Column:
        before = F.slice("spans", 1, F.greatest(F.array_position("heads", name).cast("int") - 1, F.lit(0)))
        return F.get("cells", F.aggregate(before, F.lit(0), lambda a, x: a + x))

    odd = F.when(F.size("cells") != F.col("width"), F.concat(F.lit("row has "), F.size("cells").cast("string"), F.lit(" cells, expected "), F.col("width").cast("string"))).when(F.coalesce(cell("name"), F.lit("")) == "", "no name")
    return p.select(
        "url", "place", cell("name").alias("player_name"), F.nullif(cell("location"), F.lit("")).alias("location"), F.nullif(cell("ntrp"), F.lit("")).alias("ntrp"), win_loss(cell("seasonrecord")).alias("season"), win_loss(cell("localsingles")).alias("singles"), win_loss(cell("localdoubles")).alias("doubles"),
        win_loss(cell("localrecord")).alias("local"), number(cell("rating")).alias("dynamic_rating"), F.coalesce("error", F.when(F.col("row").isNotNull(), odd)).alias("error"),
    )
