"""The two renderings of a match-history page: the rows of its table and its mobile blocks must say the same.

Row and block meet by their place. A row gains the opponents' team from its block; where the two
disagree the row has an ``error``, and a page with more of one than of the other is refused as a whole.
Tournament entries stand in both, are compared, and are not matches: they are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.grammar import href_param
from rallyframe.sources.tables import MATCH_HISTORY, cell_text, collapse, history_rows, row_cells, rows_of, us_date

# Class of a mobile block, parts of links, the word for a tournament.
BLOCK = "container496"
TEAM_LINK, RESULT_LINK = "teamprofile.aspx", "matchresults.aspx"
TOURNAMENT = "Tournament"


def _links(block: Column, target: str) -> Column:
    """(href, text) of the links to a kind of page."""
    found = F.regexp_extract_all(block, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), 0)
    pairs = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?i)href\s*=\s*[\"']([^\"']*)", 1).alias("href"), cell_text(F.regexp_extract(a, r"(?is)>(.*)</a>", 1)).alias("text")))
    return F.filter(pairs, lambda p: F.lower(p["href"]).contains(target))


def _texts(block: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(block, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1), cell_text)


def blocks_of(page: Column) -> Column:
    """The raw mobile blocks of a page."""
    mark = rf"(?is)<div[^<>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{BLOCK}(?=[\s\"'])[^<>]*>"
    return F.slice(F.split(F.coalesce(page, F.lit("")), mark, -1), 2, 1 << 30)


def mobile_blocks(pages: DataFrame) -> DataFrame:
    """url, place, teams (name and section after a bar), days and slots of the headers, results (match ids), cells (of the row that names a tournament)."""
    b = pages.select("url", F.posexplode(blocks_of(F.col("html"))).alias("place", "block"))
    return b.select("url", "place", *_block_fields())


def _block_fields() -> list[Column]:
    rows = F.transform(F.regexp_extract_all("block", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: _texts(r, "td"))
    entry = F.get(F.filter(rows, lambda cells: F.exists(cells, lambda c: F.substring_index(c, "|", 1) == TOURNAMENT)), 0)
    ids = F.transform(_links(F.col("block"), RESULT_LINK), lambda a: href_param(a["href"], "mid"))
    return [F.transform(_links(F.col("block"), TEAM_LINK), lambda a: a["text"]).alias("teams"), _texts(F.col("block"), "th").alias("heads"), ids.alias("ids"), entry.alias("entry")]


def agreed_history(pages: DataFrame) -> DataFrame:
    """The rows of ``match_history`` that are matches, with opponent_team, opponent_section and the errors of the two renderings; a page that is refused as a whole has one row with its error.

    Row and block of a place meet within their page, so nothing is shuffled and each page is read once. A row of
    ``pages`` is a page, whatever its url.
    """
    p = pages.select("url", rows_of(F.col("html"), MATCH_HISTORY).alias("rows"), blocks_of(F.col("html")).alias("blocks"))
    p = p.select("url", F.coalesce(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), F.array().cast("array<string>")).alias("rows"), "blocks")
    said = F.concat(F.lit("table has "), F.size("rows").cast("string"), F.lit(" matches, mobile blocks are "), F.size("blocks").cast("string"))
    whole = F.struct(F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("block"), said.alias("whole"))
    pairs = F.zip_with("rows", "blocks", lambda r, b: F.struct(r.alias("row"), b.alias("block"), F.lit(None).cast("string").alias("whole")))
    each = F.when(F.size("rows") == F.size("blocks"), pairs).otherwise(F.array(whole))
    both = p.select("url", F.posexplode(each).alias("place", "x")).select("url", "place", "x.row", "x.block", "x.whole")
    both = history_rows(row_cells(both.select("url", "place", "row", "whole", F.inline(F.array(F.struct(*_block_fields())))), MATCH_HISTORY))
    day, slot, tournament = us_date(F.get("heads", 0)), collapse(F.get("heads", 1)), F.col("tournament")
    entry_day, entry_slot = us_date(F.get("entry", 0)), F.get("entry", 1)
    checks = [
        (tournament & (F.size("teams") > 0), "tournament block names teams"), (tournament & (F.size("heads") > 0), "tournament block has a header"), (tournament & entry_day.isNull(), "tournament block has no day"),
        (tournament & ~entry_day.eqNullSafe(F.col("played_on")), "renderings disagree on the day"), (tournament & ~entry_slot.eqNullSafe(F.col("slot")), "renderings disagree on the slot"),
        (~tournament & (F.size("teams") != 2), "block does not name two teams"), (~tournament & (F.substring_index(F.get("teams", 1), "|", 1) == ""), "block names no opponents"), (~tournament & day.isNull(), "block has no day"), (~tournament & (F.size("ids") != 1), "block has not one result"),
        (~tournament & (day != F.col("played_on")), "renderings disagree on the day"), (~tournament & (slot != F.col("slot")), "renderings disagree on the slot"), (~tournament & ~F.get("ids", 0).eqNullSafe(F.col("source_match_id")), "renderings disagree on the match"),
    ]
    disagreement = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks])
    team = F.split(F.get("teams", 1), r"\|")
    rows = both.withColumn("error", F.when(F.col("whole").isNotNull(), F.col("whole")).when(tournament, disagreement).otherwise(F.coalesce(disagreement, F.col("error"))))
    rows = rows.where(F.col("whole").isNotNull() | ~tournament | F.col("error").isNotNull())
    kept = lambda c: F.when(F.col("whole").isNull(), c)
    return rows.select(
        "url", "place", "played_on", kept(F.col("slot")).alias("slot"), kept(F.col("source_match_id")).alias("source_match_id"), kept(F.trim(F.get(team, 0))).alias("opponent_team"), kept(F.trim(F.get(team, 1))).alias("opponent_section"), "error",
    )
