"""Queries of page and payload sources, on pages that expressions make of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.operators import pull
from rallyframe.plans import bind
from rallyframe.plans.registry import query
from rallyframe.sources import payloads, profiles, renderings, tables, widgets
from rallyframe.sources.store import written


def _cell(c: Column | str, tag: str = "td") -> Column:
    return F.concat(F.lit(f"<{tag}>"), F.coalesce((F.lit(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit(f"</{tag}>"))


def _row(*cells: Column | str, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *[_cell(c, tag) for c in cells], F.lit("</tr>"))


def _table(*rows: Column) -> Column:
    return F.concat(F.lit("<table class='x'>"), *rows, F.lit("</table>"))


def _us(day: Column) -> Column:
    return F.date_format(day, "M/d/yyyy")


_NO = "<p>none</p>"

# A player's matches as the history page shows them: defaults, ratings behind names, tiebreaks, and rows that break a rule.
_HISTORY = """, shown AS (SELECT 'p' || player_id AS url, CAST(row_number() OVER (PARTITION BY player_id ORDER BY match_id) - 1 AS INTEGER) AS place, match_id, played_on, slot, discipline, winner_side = side AS won, player_id FROM match_players)"""


def _history(s, d):
    m, k = bind.match_players(s, d), F.col("match_id")
    doubles = F.col("discipline") == "doubles"
    opponents = F.when(k % 10 == 0, "Default").otherwise(F.concat(F.lit("Opp A<br>(3.5)"), F.when(doubles & (k % 11 != 0), "<br>Opp B<br>(3.45)").otherwise("")))
    result = F.when(F.col("winner_side") == F.col("side"), "W").when(F.col("winner_side").isNotNull(), "L").otherwise("-")
    score = F.concat(F.lit("<a href='/m.aspx?a=1&amp;mid="), k.cast("string"), F.lit("&amp;b=2'>6-4<br>3-6"), F.when(k % 3 == 0, "<br>1-0").otherwise("<br>6-3"), F.lit("</a>"))
    row = _row(_us(F.col("played_on")), "Adult 18+<br>Spring", "Net &amp; Gains", F.col("slot"), F.when(doubles & (k % 10 != 0), F.concat(F.lit("Partner "), (k % 9).cast("string"))).otherwise(""), opponents, result, score, F.when(k % 4 == 0, "S").otherwise("3.71"), "(3.70)")
    head = _row("Match Date", "League", "Team", "Court", "Partner", "Opponent(s)", "W/L", "Result", "Match", "Rating", tag="th")
    rows = m.select("player_id", F.struct("match_id", row.alias("row")).alias("r")).groupBy("player_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    return rows.select(F.concat(F.lit("p"), F.col("player_id").cast("string")).alias("url"), F.concat(F.lit("<table><tr><td>menu</td></tr></table>"), _table(head, body)).alias("html"))


_BROKEN = """CASE WHEN played_on IS NULL THEN 'unparseable date' WHEN won IS NULL THEN 'unknown result' WHEN match_id % 10 <> 0 AND discipline = 'doubles' AND match_id % 11 = 0 THEN 'wrong number of opponents' END"""


@query(f"""{_HISTORY} SELECT url, place, strftime(played_on, '%Y-%m-%d') AS played_on, 'Adult 18+ Spring' AS league_context, 'Net & Gains' AS team_name, slot, discipline, CASE WHEN discipline = 'doubles' AND match_id % 10 <> 0 THEN 'Partner ' || (match_id % 9) END AS partner,
  CASE WHEN match_id % 10 = 0 THEN '' WHEN discipline = 'doubles' AND match_id % 11 <> 0 THEN 'Opp A,Opp B' ELSE 'Opp A' END AS opponents, match_id % 10 = 0 AS defaulted, CASE WHEN won THEN 'W' WHEN NOT won THEN 'L' END AS result,
  CASE WHEN match_id % 3 = 0 THEN '6-4 3-6 1-0 tiebreak' ELSE '6-4 3-6 6-3' END AS sets, CAST(match_id AS VARCHAR) AS source_match_id, CASE WHEN match_id % 4 <> 0 THEN 3.71 END AS match_rating, match_id % 4 = 0 AS self_rated, CAST(3.70 AS DOUBLE) AS resulting_rating, {_BROKEN} AS error FROM shown""")
def match_history_rows(s, d):
    h = tables.match_history(_history(s, d))
    score = F.array_join(F.transform("sets", lambda x: F.concat(x.winner.cast("string"), F.lit("-"), x.loser.cast("string"), F.when(x.match_tiebreak, " tiebreak").otherwise(""))), " ")
    columns = ["url", "place", "played_on", "league_context", "team_name", "slot", "discipline", "partner", F.array_join("opponents", ",").alias("opponents"), "defaulted", "result", score.alias("sets"), "source_match_id", "match_rating", "self_rated", "resulting_rating", "error"]
    return h.select(*columns)


@query(f"""{_HISTORY}, bad AS (SELECT url, {_BROKEN} AS error FROM shown) SELECT url, string_agg(DISTINCT error, ',' ORDER BY error) AS errors FROM bad WHERE error IS NOT NULL GROUP BY 1""")
def refused_pages(s, d):
    """Pages with a broken row give nothing but their refusal."""
    return pull.refused_pages(tables.match_history(_history(s, d))).select("url", F.array_join("errors", ",").alias("errors"))


# The rows of each player's history that break no rule, defaults among them: those name no partner and no opponents.
_SOUND = f"""{_HISTORY}, sound AS (SELECT * FROM shown WHERE {_BROKEN} IS NULL)"""


def _sound(s, d, *columns: str):
    """All sound rows with ``columns``, and the pages' players."""
    h = written(tables.match_history(_history(s, d)).where("error IS NULL").select("url", "error", "source_match_id", "slot", "discipline", *columns), "history")
    return h, h.select("url", F.concat(F.lit("Player "), F.substring("url", 2, 20)).alias("name")).distinct()


@query(f"""{_SOUND} SELECT url, CAST(match_id AS VARCHAR) AS source_match_id, slot, discipline, CASE WHEN won THEN 'home' ELSE 'visiting' END AS winner_side, CASE WHEN match_id % 3 = 0 THEN '6-4 3-6 1-0' ELSE '6-4 3-6 6-3' END AS score, 'Adult 18+ Spring' AS league_context, played_on FROM sound""")
def pulled_courts(s, d):
    return pull.courts(_sound(s, d, "result", "sets", "league_context", "played_on")[0])


@query(f"""{_SOUND} SELECT url, CAST(match_id AS VARCHAR) AS source_match_id, slot, 'Player ' || player_id AS name, 'home' AS side FROM sound UNION ALL SELECT url, CAST(match_id AS VARCHAR), slot, 'Partner ' || (match_id % 9), 'home' FROM sound WHERE discipline = 'doubles' AND match_id % 10 <> 0
UNION ALL SELECT url, CAST(match_id AS VARCHAR), slot, 'Opp A', 'visiting' FROM sound WHERE match_id % 10 <> 0 UNION ALL SELECT url, CAST(match_id AS VARCHAR), slot, 'Opp B', 'visiting' FROM sound WHERE discipline = 'doubles' AND match_id % 10 <> 0""")
def pulled_participants(s, d):
    return pull.participants(*_sound(s, d, "partner", "opponents"))


def _team_pages(s, d):
    """A page for each team: line of context (every third without an age band), roster (every fifth with postseason columns, every eleventh without its rating column), schedule."""
    k = F.col("team_id")
    head = ["Name", "Location", "NTRP", "2026 Record", "Local Singles", "Local Doubles", "Local Record"]
    p = bind.players(s, d)
    cells = [F.col("name"), F.when(F.col("player_id") % 3 != 0, "Tulsa, OK").otherwise(""), "4.0C", F.concat((F.col("player_id") % 7).cast("string"), F.lit(" - 2")), "1-0", "-", "0-3"]
    row = F.concat(F.lit("<tr>"), _cell(cells[0]), F.when(k % 5 == 0, "<td>1-1</td><td>x</td>").otherwise(""), *[_cell(c) for c in cells[1:]], F.when(k % 11 != 0, _cell("3.9")).otherwise(""), F.lit("</tr>"))
    roster = p.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("player_id", row.alias("row")))).alias("r"))
    m = bind.team_matches(s, d)
    line = _row(_us(F.col("played_on")), F.col("scheduled_time"), F.concat(F.lit("Team "), F.col("visiting_team_id").cast("string")), F.col("site"), F.when(F.col("home_courts_won").isNotNull(), F.concat_ws("-", F.col("home_courts_won").cast("string"), F.col("visiting_courts_won").cast("string"))))
    games = m.select(F.col("home_team_id").alias("team_id"), F.struct("match_id", line.alias("row")).alias("g")).groupBy("team_id").agg(F.sort_array(F.collect_list("g")).alias("g"))
    top = F.concat(F.lit("<tr>"), _cell("Name", "th"), F.when(k % 5 == 0, "<th colspan='2'>Postseason Record</th>").otherwise(""), *[_cell(h, "th") for h in head[1:]], F.when(k % 11 != 0, "<th>Rating</th>").otherwise(""), F.lit("</tr>"))
    context = F.concat(F.lit("Adult "), F.when(k % 3 != 0, "18+ ").otherwise(""), F.lit("Missouri Valley "), F.when(k % 2 == 0, "M").otherwise("W"), F.lit(" 4.0"))
    t = bind.teams(s, d).join(roster, "team_id", "left").join(games, "team_id", "left")
    html = F.concat(
        _table(_row(context), _row(F.when(k % 4 != 0, "2026 Spring").otherwise("")), _row(F.col("team_name"))), _table(top, F.coalesce(F.array_join(F.transform("r", lambda r: r["row"]), ""), F.lit(""))),
        _table(_row("Local Schedule", "Time", "Opponent", "Match Site", "Result", tag="th"), F.coalesce(F.array_join(F.transform("g", lambda r: r["row"]), ""), F.lit(""))),
    )
    return t.select(F.concat(F.lit("t"), k.cast("string")).alias("url"), html.alias("html"))


@query("""SELECT 't' || n_nationkey AS url, n_name AS team_name, CASE WHEN n_nationkey % 4 <> 0 THEN '2026 Spring' END AS season_name, CASE WHEN n_nationkey % 3 <> 0 THEN 'Adult 18+' END AS league_type,
  CASE WHEN n_nationkey % 3 <> 0 THEN 'Missouri Valley' ELSE 'Adult Missouri Valley' END AS section, CASE WHEN n_nationkey % 2 = 0 THEN 'M' ELSE 'W' END AS gender, '4.0' AS rating_level, CAST(NULL AS VARCHAR) AS error FROM nation""", base=False)
def team_page_headers(s, d):
    return profiles.team_header(_team_pages(s, d))


@query("""SELECT 't' || team_id AS url, CAST(row_number() OVER (PARTITION BY team_id ORDER BY player_id) - 1 AS INTEGER) AS place, name AS player_name, CASE WHEN player_id % 3 <> 0 THEN 'Tulsa, OK' END AS location, '4.0C' AS ntrp, (player_id % 7) || ':2' AS season, '1:0' AS singles,
  CAST(NULL AS VARCHAR) AS doubles, '0:3' AS local, CAST(3.9 AS DOUBLE) AS dynamic_rating, CAST(NULL AS VARCHAR) AS error FROM players WHERE team_id % 11 <> 0
UNION ALL SELECT 't' || n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing columns rating' FROM nation WHERE n_nationkey % 11 = 0""")
def team_page_rosters(s, d):
    def counts(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat_ws(":", F.col(f"{c}.wins").cast("string"), F.col(f"{c}.losses").cast("string"))).alias(c)

    return profiles.team_roster(_team_pages(s, d)).select("url", "place", "player_name", "location", "ntrp", *map(counts, ("season", "singles", "doubles", "local")), "dynamic_rating", "error")


@query("""SELECT 't' || home_team_id AS url, CAST(row_number() OVER (PARTITION BY home_team_id ORDER BY match_id) - 1 AS INTEGER) AS place, strftime(played_on, '%Y-%m-%d') AS played_on, trim(regexp_replace(coalesce(scheduled_time, ''), '\\s+', ' ', 'g')) AS time, 'Team ' || visiting_team_id AS opponent,
  coalesce(site, '') AS site, CASE WHEN home_courts_won IS NULL THEN '' ELSE home_courts_won || '-' || visiting_courts_won END AS result, CAST(NULL AS VARCHAR) AS error FROM team_matches""")
def team_page_schedules(s, d):
    return tables.schedule(_team_pages(s, d))


def _player_pages(s, d):
    """A page for each player: header with a level and a letter, areas, recent teams, seasons; some parts missing or broken."""
    k = F.col("player_id")
    letter = F.get(F.array(*map(F.lit, ("C", "s", "", "X"))), k % 4)
    dynamic = F.when(k % 5 != 0, F.concat(F.lit("3.6"), (k % 10).cast("string"), F.lit("<br>1/5/2026"))).otherwise("-----")
    head = _table(_row(F.concat("name", F.when(k % 3 == 0, " (Tulsa, OK)").otherwise(""), F.lit("<br>"), F.when(k % 2 == 0, "Female").otherwise("Male")), F.concat(F.lit("4.5 "), letter, F.lit("<br>12/31/2025"))), _row("Estimated Dynamic Rating", dynamic))
    areas = F.when(k % 6 == 0, _NO).otherwise(_table(_row("Current Playing Areas (Player Rating Lists)"), _row("Tulsa"), _row(""), _row("Norman &amp; Moore")))
    team = _table(_row("Recent Team", "Type", "Section", "Gender", "Rating", "Match Start", tag="th"), _row(F.concat(F.lit("T"), F.col("team_id").cast("string")), "Adult 18+", "Sec", "F", "4.0", "3/1/2026"), F.when(k % 7 == 0, _row("", "Adult", "", "", "", "")).otherwise(""))
    wins = (k % 9).cast("string")
    season = F.when(k % 8 == 0, _NO).otherwise(_table(
        _row("All Matches", "Total<br>Matches", "Win", "Loss", "W Pct", "Total Sets", "Win", "Loss", "W Pct", "Total Games", "Win", "Loss", "W Pct", "Defaults", tag="th"), _row("2026", "9", wins, "2", "66%", "7", "5", "2", "71%", "60", "35", "25", "58%", "0"), _row("Total", "x", *["1"] * 12),
    ))
    html = F.when(k % 13 == 0, _NO).otherwise(F.concat(head, areas, team, season))
    return bind.players(s, d).select(F.concat(F.lit("p"), k.cast("string")).alias("url"), html.alias("html"))


@query("""SELECT 'p' || player_id AS url, CASE WHEN player_id % 13 <> 0 THEN name END AS name, CASE WHEN player_id % 13 <> 0 AND player_id % 3 = 0 THEN 'Tulsa, OK' END AS location, CASE WHEN player_id % 13 = 0 THEN NULL WHEN player_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN player_id % 13 = 0 THEN NULL ELSE '4.5' || CASE player_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'S' WHEN 3 THEN 'X' ELSE '' END || '@2025-12-31' END AS ntrp, CASE WHEN player_id % 13 <> 0 AND player_id % 5 <> 0 THEN '3.6' || (player_id % 10) || '@2026-01-05' END AS dynamic_rating,
  CASE WHEN player_id % 13 = 0 THEN 'header not found' WHEN player_id % 4 = 3 THEN 'unknown rating type X' END AS error FROM players""")
def player_headers(s, d):
    h = profiles.player_header(_player_pages(s, d))
    level = F.when(F.col("ntrp").isNotNull(), F.concat(F.col("ntrp.value").cast("string"), F.coalesce("ntrp.rating_type", F.lit("")), F.lit("@"), "ntrp.observed_on"))
    dynamic = F.when(F.col("dynamic_rating").isNotNull(), F.concat(F.format_number("dynamic_rating.value", 2), F.lit("@"), "dynamic_rating.observed_on"))
    return h.select("url", "name", "location", "gender", level.alias("ntrp"), dynamic.alias("dynamic_rating"), "error")


@query("""SELECT 'p' || player_id AS url, CAST(a.place AS INTEGER) AS place, a.area FROM players, (VALUES (0, 'Tulsa'), (2, 'Norman & Moore')) a(place, area) WHERE player_id % 13 <> 0 AND player_id % 6 <> 0""")
def player_areas(s, d):
    return profiles.playing_areas(_player_pages(s, d))


@query("""SELECT 'p' || player_id AS url, CAST(0 AS INTEGER) AS place, 'T' || team_id AS team_name, 'Adult 18+' AS league_type, '2026-03-01' AS match_start_on, CAST(NULL AS VARCHAR) AS error FROM players WHERE player_id % 13 <> 0
UNION ALL SELECT 'p' || player_id, 1, '', 'Adult', NULL, 'no team name' FROM players WHERE player_id % 13 <> 0 AND player_id % 7 = 0""")
def player_recent_teams(s, d):
    return profiles.recent_teams(_player_pages(s, d)).select("url", "place", "team_name", "league_type", "match_start_on", "error")


@query("""SELECT 'p' || player_id AS url, CAST(0 AS INTEGER) AS place, '2026' AS year, CAST(9 AS INTEGER) AS matches, CAST(player_id % 9 AS INTEGER) AS wins, CAST(60 AS INTEGER) AS games, CAST(0 AS INTEGER) AS defaults, CAST(NULL AS VARCHAR) AS error FROM players WHERE player_id % 13 <> 0 AND player_id % 8 <> 0
UNION ALL SELECT 'p' || player_id, 1, 'Total', NULL, 1, 1, 1, 'not a count' FROM players WHERE player_id % 13 <> 0 AND player_id % 8 <> 0 UNION ALL SELECT 'p' || player_id, NULL, NULL, NULL, NULL, NULL, NULL, 'table not found' FROM players WHERE player_id % 13 = 0 OR player_id % 8 = 0""")
def player_seasons(s, d):
    return profiles.season_records(_player_pages(s, d)).select("url", "place", "year", F.col("matches.total").alias("matches"), F.col("matches.wins").alias("wins"), F.col("games.total").alias("games"), "defaults", "error")


def _widgets(s, d):
    """A rating widget for each player: with one or two sections, a zone, dates; some absent, doubled or without a date."""
    k, w = F.col("player_id"), widgets.WIDGET

    def section(title: str, value: Column, dated: Column) -> Column:
        return F.concat(F.lit(f"<div class='{w}__section'><h3 class='{w}__section-title'>{title}</h3><span class=\"{w}__section-value\">"), value, F.lit(f"</span><i class='{w}__section-confidence'>High</i><p class='{w}__section-zone'>Zone 21.5 to 23 x</p>"), dated, F.lit("</div>"))

    day = F.lit(f"<p class='{w}__section-subtitle'>Updated 3/4/26</p><p class='{w}__section-subtitle'>Last Played 12/31/2025</p><p class='{w}__section-subtitle'>Updated daily 1/1/2026 or so</p>")
    value = F.concat(F.lit("22."), (k % 10).cast("string"))
    one = section("WTN Singles", value, F.when(k % 7 == 0, "").otherwise(day))
    two = F.when(k % 3 == 0, section("WTN Doubles", F.lit("19.0"), day)).otherwise("")
    box = F.concat(F.lit(f"<div class='{w} big'><a class='{w}__navigation-link' href='/x?tennis-id=A"), k.cast("string"), F.lit("&amp;y=1'>go</a>"), one, two, F.lit("</div>"))
    html = F.when(k % 11 == 0, _NO).when(k % 13 == 0, F.concat(box, box)).otherwise(box)
    return bind.players(s, d).select(F.concat(F.lit("p"), k.cast("string")).alias("url"), html.alias("html"))


@query("""SELECT 'p' || player_id AS url, CASE WHEN player_id % 11 <> 0 THEN 'A' || player_id END AS tennis_id, CASE WHEN e IS NULL AND player_id % 11 <> 0 THEN '22.' || (player_id % 10) || ' High 21.5-23.0 2026-03-04 2025-12-31' END AS singles, CASE WHEN e IS NULL AND player_id % 11 <> 0 AND player_id % 3 = 0 THEN '19.0 High 21.5-23.0 2026-03-04 2025-12-31' END AS doubles, e AS error
FROM (SELECT player_id, CASE WHEN player_id % 11 = 0 THEN NULL WHEN player_id % 13 = 0 THEN 'several widgets' WHEN player_id % 7 = 0 THEN 'no date' END AS e FROM players) x""")
def rating_widgets(s, d):
    def line(c: str) -> Column:
        f = F.col(c)
        return F.when(f.isNotNull(), F.concat_ws(" ", f.value.cast("string"), f.confidence, F.concat(f.zone_from.cast("string"), F.lit("-"), f.zone_to.cast("string")), f.updated_on, f.last_played_on)).alias(c)

    return widgets.rating_widget(_widgets(s, d)).select("url", "tennis_id", line("singles"), line("doubles"), "error")


@query("""SELECT 'https://x.org/p?tennis-id=B' || player_id || '&v=2' AS url, 'B' || player_id AS tennis_id, CASE WHEN player_id % 7 = 0 THEN NULL ELSE name END AS name, CASE WHEN player_id % 7 = 0 OR player_id % 5 = 0 AND player_id % 3 <> 0 THEN NULL ELSE 'Male' END AS gender, CASE WHEN player_id % 7 = 0 OR player_id % 5 = 0 AND player_id % 3 <> 0 THEN NULL ELSE '18-24' END AS age_range,
  CASE WHEN player_id % 7 = 0 THEN 'identity not found' WHEN player_id % 5 = 0 AND player_id % 3 <> 0 THEN 'no identity line' WHEN player_id % 5 <> 0 AND player_id % 3 = 0 THEN 'several identity lines' END AS error FROM players""")
def identity_pages(s, d):
    k = F.col("player_id")
    line = F.lit("<p>Male<br>18-24<br>x</p>")
    block = F.concat(F.lit("<div class='a playerDetailsHeader b'><h2>"), "name", F.lit("</h2><p>Tulsa</p>"), F.when(k % 5 == 0, "<p>Other<br>18-24<br></p>").otherwise(line), F.when(k % 3 == 0, line).otherwise(""), F.lit("</div>"))
    pages = bind.players(s, d).select(F.concat(F.lit("https://x.org/p?tennis-id=B"), k.cast("string"), F.lit("&v=2")).alias("url"), F.when(k % 7 == 0, _NO).otherwise(block).alias("html"))
    return widgets.identity_page(pages)


@query("""SELECT match_id, CAST(place AS INTEGER) AS place, CASE WHEN place = 0 THEN upper(slot) ELSE CASE WHEN match_id % 9 = 0 THEN upper(slot) ELSE 'X9' END END AS slot, refusals FROM (SELECT match_id, slot, discipline, p.place,
  concat_ws(',', CASE WHEN match_id % 6 = 0 THEN 'not a day' END, CASE WHEN match_id % 9 = 0 THEN 'slot given twice' END, CASE WHEN p.place = 1 AND match_id % 7 = 0 THEN 'unknown discipline' END, CASE WHEN p.place = 0 AND discipline = 'doubles' THEN 'wrong number of home players' END,
    CASE WHEN p.place = 0 AND match_id % 8 = 0 THEN 'unknown winner' END) AS refusals FROM court_matches, (VALUES (0), (1)) p(place)) y""")
def scorecard_payloads(s, d):
    k, m = F.col("match_id"), bind.court_matches(s, d)

    def court(slot: Column, discipline: Column, home: Column, visiting: Column, winner: Column) -> Column:
        return F.struct(slot.alias("slot"), discipline.alias("discipline"), home.alias("homePlayers"), visiting.alias("visitingPlayers"), winner.alias("winnerSide"), F.lit("6-4 6-4").alias("score"), F.lit(False).alias("defaulted"))

    one, two = F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))
    first = court(F.lower("slot"), F.col("discipline"), one, F.when(F.col("discipline") == "singles", one).otherwise(two), F.when(k % 8 == 0, "nobody").otherwise("home"))
    second = court(F.when(k % 9 == 0, F.concat(F.lit(" "), "slot")).otherwise("x9"), F.when(k % 7 == 0, "triples").otherwise("doubles"), two, two, F.lit(None).cast("string"))
    card = F.struct(F.when(k % 6 == 0, "2026-02-30").otherwise("2026-02-28").alias("playedOn"), F.lit("A").alias("homeTeam"), F.lit("B").alias("visitingTeam"), F.array(first, second).alias("courts"))
    out = payloads.scorecards(m.select("match_id", F.to_json(card).alias("payload")))
    return out.select("match_id", "place", "slot", F.array_join("refusals", ",").alias("refusals"))


@query("""SELECT n_nationkey AS team_id, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS team, 'Opening week' AS event, CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE coalesce(p.n, 0) END AS players, CASE WHEN n_nationkey % 5 = 0 THEN 'no team' WHEN n_nationkey % 7 = 0 OR coalesce(p.n, 0) = 0 THEN 'no players' END AS refusal
FROM nation LEFT JOIN (SELECT team_id, count(*) AS n FROM players GROUP BY 1) p ON p.team_id = n_nationkey""")
def roster_payloads(s, d):
    k = F.col("team_id")
    members = bind.players(s, d).groupBy("team_id").agg(F.collect_list("name").alias("names"))
    t = bind.teams(s, d).join(members, "team_id", "left")
    given = F.when((k % 7 == 0) | F.col("names").isNull(), F.array().cast("array<string>")).otherwise(F.col("names"))
    card = F.struct(F.when(k % 5 == 0, "").otherwise(F.col("team_name")).alias("team"), F.lit("Opening week").alias("event"), given.alias("players"))
    return payloads.rosters(t.select("team_id", F.to_json(card).alias("payload"))).select("team_id", "team", "event", F.size("players").cast("long").alias("players"), "refusal")


# History pages in both renderings: every seventh court is a tournament entry, some blocks differ, some pages lack a block.
def _two_renderings(s, d):
    m, k = bind.match_players(s, d).where("player_id % 3 <> 0"), F.col("match_id")
    day, entry = _us(F.col("played_on")), k % 7 == 0
    row = F.concat(F.lit("<tr>"), *[_cell(c) for c in (day, F.when(entry, "Tournament").otherwise("Adult 18+"), "Net Gains", F.col("slot"), F.when(F.col("discipline") == "doubles", "Al").otherwise(""), F.when(F.col("discipline") == "doubles", "Opp A<br>(3.5)<br>Opp B").otherwise("Opp A"), "w", F.concat(F.lit("<a href='/matchresults.aspx?mid="), k.cast("string"), F.lit("'>6-4<br>6-4</a>")), "3.7", "3.7")], F.lit("</tr>"))
    other_day = F.when(k % 11 == 1, "1/1/1999").otherwise(day)
    other_slot = F.when(k % 13 == 2, "S9").otherwise(F.col("slot"))
    league = F.concat(
        F.lit("<table><tr>"), _cell(other_day, "th"), _cell(other_slot, "th"), F.lit("</tr><tr><td><a href='/teamprofile.aspx?t=1'>Net Gains</a></td><td><a href='/teamprofile.aspx?t=2'>Rivals "), (k % 5).cast("string"), F.lit("<br>Heart of America</a></td></tr></table>"),
        F.lit("<a href='/matchresults.aspx?mid="), F.when(k % 17 == 3, "zz").otherwise(k.cast("string")), F.lit("'>x</a>"),
    )
    tournament = F.concat(F.lit("<table><tr>"), _cell(other_day), _cell(other_slot), F.lit("<td>Tournament<br>Open</td></tr></table>"))
    block = F.concat(F.lit("<div class='container496 x'>"), F.when(entry, tournament).otherwise(league), F.lit("</div>"))
    rows = m.where("played_on IS NOT NULL").groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("match_id", row.alias("row"), block.alias("block")))).alias("r"))
    head = _row("Match Date", "League", "Team", "Court", "Partner", "Opponent(s)", "W/L", "Result", "Match", "Rating", tag="th")
    blocks = F.when(F.col("player_id") % 10 == 1, F.slice("r", 2, 1 << 20)).otherwise(F.col("r"))
    html = F.concat(F.lit("<div class='large'>"), _table(head, F.array_join(F.transform("r", lambda x: x["row"]), "")), F.lit("</div><div class='small'>"), F.array_join(F.transform(blocks, lambda x: x["block"]), ""), F.lit("</div>"))
    return rows.select(F.concat(F.lit("p"), F.col("player_id").cast("string")).alias("url"), html.alias("html"))


@query("""SELECT url, place, played_on, slot, source_match_id, opponent_team, opponent_section, error FROM (
SELECT 'p' || player_id AS url, player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY match_id) - 1 AS INTEGER) AS place, strftime(played_on, '%Y-%m-%d') AS played_on, slot, CAST(match_id AS VARCHAR) AS source_match_id, match_id % 7 = 0 AS entry,
  CASE WHEN match_id % 7 <> 0 THEN 'Rivals ' || (match_id % 5) END AS opponent_team, CASE WHEN match_id % 7 <> 0 THEN 'Heart of America' END AS opponent_section,
  CASE WHEN match_id % 11 = 1 AND played_on <> DATE '1999-01-01' THEN 'renderings disagree on the day' WHEN match_id % 13 = 2 THEN 'renderings disagree on the slot' WHEN match_id % 7 <> 0 AND match_id % 17 = 3 THEN 'renderings disagree on the match' END AS error
FROM match_players WHERE player_id % 3 <> 0 AND played_on IS NOT NULL) x WHERE player_id % 10 <> 1 AND (NOT entry OR error IS NOT NULL)
UNION ALL SELECT 'p' || player_id, NULL, NULL, NULL, NULL, NULL, NULL, 'table has ' || count(*) || ' matches, mobile blocks are ' || (count(*) - 1) FROM match_players WHERE player_id % 3 <> 0 AND player_id % 10 = 1 AND played_on IS NOT NULL GROUP BY player_id""")
def agreed_renderings(s, d):
    return renderings.agreed_history(_two_renderings(s, d))


@query("""SELECT 'https://x.org/p#uaid=' || player_id AS url, name, CAST(player_id AS VARCHAR) AS uaid, CASE player_id % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' END AS gender, CASE WHEN player_id % 4 IN (0, 1) THEN 'Tulsa, OK' WHEN player_id % 4 = 3 THEN NULL END AS location, 'Missouri Valley' AS section,
  CASE WHEN player_id % 4 <> 3 THEN 'Oklahoma' END AS district, 'A' || player_id AS tennis_id, CASE WHEN player_id % 5 = 0 THEN NULL ELSE '4.5' || CASE WHEN player_id % 3 = 0 THEN 'C' WHEN player_id % 3 = 1 THEN '' ELSE 'X' END || '@2025-12-31' END AS ntrp,
  CASE WHEN player_id % 4 = 3 THEN 'no identity line' WHEN player_id % 5 <> 0 AND player_id % 3 = 2 THEN 'unknown rating type' END AS error FROM players""")
def captured_profiles(s, d):
    """Pages captured behind a login, in the layouts that their context block has had."""
    k = F.col("player_id")
    context = F.when(k % 4 == 0, "<p>Competition Category: Male</p><p>Tulsa, OK | Section: Missouri Valley</p><p>District: Oklahoma</p>").when(k % 4 == 1, "<p>Female | Tulsa, OK</p><p>Section: Missouri Valley | District: Oklahoma</p>").when(k % 4 == 2, "<p>Nationality: USA</p><p>Competition Category: Male | Section: Missouri Valley | District: Oklahoma</p>").otherwise("<p>Section: Missouri Valley</p>")
    letter = F.when(k % 3 == 0, " c").when(k % 3 == 1, "").otherwise(" x")
    level = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<div data-element-name='ntrpSummary'><span class='readonly-text__text'>4.5"), letter, F.lit("</span><span class='readonly-text__subtext'>as of 12/31/25</span></div>")))
    html = F.concat(F.lit("<div data-element-name=\"fullName\"><div class='readonly-text__text'><h3> "), "name", F.lit(" </h3></div></div><div data-element-name='nameGenderAddress'><div class='readonly-text__text'>"), context, F.lit("</div></div>"), level, F.lit("<a class='v-form-wtn-widget__navigation-link' href='/x?tennis-id=A"), k.cast("string"), F.lit("'>go</a>"))
    p = widgets.captured_profile(bind.players(s, d).select(F.concat(F.lit("https://x.org/p#uaid="), k.cast("string")).alias("url"), html.alias("html")))
    ntrp = F.when(F.col("ntrp").isNotNull(), F.concat(F.col("ntrp.value").cast("string"), F.coalesce("ntrp.rating_type", F.lit("")), F.lit("@"), "ntrp.observed_on"))
    return p.withColumn("ntrp", ntrp)
