"""Queries of lineups on a team's own evidence, and the SQL of what SQL can say."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import grammar
from rallyframe.operators import lineup, ratings, records, roster
from rallyframe.plans import bind, catalog
from rallyframe.plans.registry import query
from rallyframe.sources.store import written

HOME = "O"  # the side that stands for the home team

_OWN = f"""{catalog._ROSTER}, played AS (SELECT r.team_id, r.event_id, m.match_id, m.slot, m.discipline, m.player_id, m.side, CASE WHEN r.team_id = t.home_team_id THEN m.side = '{HOME}' WHEN r.team_id = t.visiting_team_id THEN m.side <> '{HOME}' END AS ours
  FROM match_players m JOIN resolved r ON r.player_id = m.player_id LEFT JOIN team_matches t ON t.match_id = m.match_id)"""


def _roster(s, d):
    return roster.resolve_rosters(bind.memberships(s, d), bind.entries(s, d))


def _played(s, d, members=None):
    """Roster players' rows, with whether their team played and stood there."""
    members = _roster(s, d) if members is None else members
    rows = bind.match_players(s, d).select("match_id", "slot", "discipline", "player_id", "side")
    return roster.own_team_rows(rows, bind.match_sides(s, d), members, HOME)


def _courts(s, d):
    """event_id, slot, discipline and place of the events that have a format."""
    e = bind.events(s, d).where("format IS NOT NULL").select("event_id", grammar.event_format(F.col("format")).alias("f"))
    return e.select("event_id", F.posexplode("f.courts").alias("place", "c")).select("event_id", "c.slot", "c.discipline", F.col("place").cast("long").alias("place"))


@query(f"{_OWN} SELECT team_id, player_id, count(*) AS matches FROM played WHERE ours IS NOT NULL AND discipline = 'singles' GROUP BY 1, 2")
def own_singles_counts(s, d):
    return lineup.own_singles(_played(s, d).where("ours IS NOT NULL"))


@query(f"""{_OWN} SELECT a.team_id, a.player_id AS low_id, b.player_id AS high_id, a.slot, count(*) AS matches FROM played a JOIN played b ON a.team_id = b.team_id AND a.match_id = b.match_id AND a.side = b.side AND a.player_id < b.player_id
  WHERE a.ours IS NOT NULL AND b.ours IS NOT NULL AND a.discipline <> 'singles' GROUP BY 1, 2, 3, 4""")
def own_pair_slots(s, d):
    return lineup.own_pairs(_played(s, d).where("ours IS NOT NULL"))


_SLOTTED = """, courts AS (SELECT team_id, slot, discipline, count(DISTINCT match_id) AS n FROM played WHERE ours IS NOT NULL GROUP BY 1, 2, 3),
modal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id, slot ORDER BY n DESC, discipline) AS k FROM courts) x WHERE k = 1),
observed AS (SELECT team_id, slot, discipline, row_number() OVER (PARTITION BY team_id ORDER BY CASE discipline WHEN 'singles' THEN 0 WHEN 'doubles' THEN 1 ELSE 2 END, CAST(regexp_extract(slot, '[0-9]+$') AS INTEGER), slot) AS place FROM modal)"""


@query(f"{_OWN}{_SLOTTED} SELECT team_id, slot, discipline, place FROM observed")
def observed_slots(s, d):
    return lineup.observed_slots(_played(s, d).where("ours IS NOT NULL"))


def _plan_slots(s, d, own=None):
    """Each team's slots: those of its event's format, else those observed."""
    entries, courts = bind.entries(s, d), _courts(s, d)
    formal = entries.join(courts, "event_id").select("team_id", "slot", "discipline", "place")
    own = _played(s, d).where("ours IS NOT NULL") if own is None else own
    seen = lineup.observed_slots(own).join(formal.select("team_id").distinct(), "team_id", "leftanti")
    return formal.union(seen.select("team_id", "slot", "discipline", "place"))


def _ranks(s, d, members=None):
    """Ranks of the rosters; the last ratings, which are used twice, are made once and written."""
    members = (_roster(s, d) if members is None else members).select("team_id", "player_id")
    last = written(ratings.latest(bind.ratings(s, d)), "latest")
    return ratings.roster_rank(members, last, ratings.choose_source(members, last, catalog.PRECEDENCE), catalog.INVERTED)


_STATUS = f"""{_OWN}, sizes AS (SELECT team_id, count(*) AS roster_size, min(scope) AS roster_source FROM resolved GROUP BY 1), own AS (SELECT team_id, count(DISTINCT CASE WHEN ours IS NOT NULL THEN match_id END) AS observed, count(DISTINCT match_id) AS every FROM played GROUP BY 1),
status AS (SELECT e.team_id, e.event_id, CASE WHEN s.team_id IS NULL THEN 'no roster' WHEN coalesce(o.observed, 0) = 0 THEN 'no history' ELSE 'predicted' END AS status, coalesce(s.roster_size, 0) AS roster_size, s.roster_source, CASE WHEN h.format IS NULL THEN 'observed' ELSE 'event-format' END AS slot_source,
  coalesce(o.observed, 0) AS observed, coalesce(o.every, 0) - coalesce(o.observed, 0) AS excluded_other_team FROM entries e JOIN happenings h ON h.event_id = e.event_id LEFT JOIN sizes s ON s.team_id = e.team_id LEFT JOIN own o ON o.team_id = e.team_id)"""


def _status(s, d, rows=None, members=None):
    rows = _played(s, d) if rows is None else rows
    members = _roster(s, d) if members is None else members
    formats = bind.events(s, d).select("event_id").join(_courts(s, d).groupBy("event_id").agg(F.count("*").alias("courts")), "event_id", "left")
    return lineup.plan_status(bind.entries(s, d), members, rows.where("ours IS NOT NULL"), rows, formats)


@query(f"{_STATUS} SELECT * FROM status")
def lineup_plan_status(s, d):
    return _status(s, d)


class Evidence(NamedTuple):
    """What lineups rest on, each computed once and written: rosters, their players' rows, status of the entries, and slots and ranks of the teams that can be predicted."""

    members: DataFrame
    rows: DataFrame
    status: DataFrame
    slots: DataFrame
    ranks: DataFrame

    @property
    def own(self) -> DataFrame:
        return self.rows.where("ours IS NOT NULL")


def _evidence(s, d) -> Evidence:
    members = written(_roster(s, d), "members")
    rows = written(_played(s, d, members), "played")
    status = written(_status(s, d, rows, members), "status")
    able = status.where("status = 'predicted'").select("team_id")
    slots = written(_plan_slots(s, d, rows.where("ours IS NOT NULL")).join(able, "team_id", "leftsemi"), "slots")
    return Evidence(members, rows, status, slots, written(_ranks(s, d, members).join(able, "team_id", "leftsemi"), "ranks"))


def _plan(s, d, evidence=None):
    """The predicted lineups."""
    e = _evidence(s, d) if evidence is None else evidence
    return lineup.predicted_lineup(e.slots, e.ranks, lineup.own_singles(e.own), lineup.own_pairs(e.own)).withColumn("confidence", records.confidence(F.col("support")))


@query()
def predicted_lineup(s, d):
    return _plan(s, d)


@query()
def lineup_unplaced(s, d):
    e = _evidence(s, d)
    return lineup.unplaced(_plan(s, d, e), e.members.select("team_id", "player_id"), e.own)


# The singles courts of a plan in SQL: the players in order of singles matches, rank and id.
@query(f"""{_STATUS}{_SLOTTED}, latest AS (SELECT player_id, source, value FROM (SELECT *, row_number() OVER (PARTITION BY player_id, source ORDER BY observed_on DESC, rating_id DESC) AS k FROM ratings) x WHERE k = 1),
covered AS (SELECT p.team_id, l.source, count(*) AS covered FROM resolved p JOIN latest l ON l.player_id = p.player_id GROUP BY 1, 2),
best AS (SELECT team_id, source FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY covered DESC, CASE source {' '.join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(catalog.PRECEDENCE))} ELSE 9 END, source) AS k FROM covered) x WHERE k = 1),
rated AS (SELECT r.team_id, r.player_id, CASE WHEN b.source IN ('error', 'click') THEN -l.value ELSE l.value END AS strength FROM resolved r LEFT JOIN best b ON b.team_id = r.team_id LEFT JOIN latest l ON l.player_id = r.player_id AND l.source = b.source),
ranked AS (SELECT *, CASE WHEN strength IS NULL THEN count(strength) OVER (PARTITION BY team_id) ELSE row_number() OVER (PARTITION BY team_id ORDER BY strength DESC NULLS LAST, player_id) - 1 END AS rank FROM rated),
solo AS (SELECT team_id, player_id, count(*) AS n FROM played WHERE ours IS NOT NULL AND discipline = 'singles' GROUP BY 1, 2),
queue AS (SELECT k.team_id, k.player_id, coalesce(s.n, 0) AS n, row_number() OVER (PARTITION BY k.team_id ORDER BY coalesce(s.n, 0) DESC, k.rank, k.player_id) AS turn FROM ranked k LEFT JOIN solo s ON s.team_id = k.team_id AND s.player_id = k.player_id),
slots AS (SELECT e.team_id, c.slot, c.turn FROM entries e JOIN happenings h ON h.event_id = e.event_id JOIN (VALUES ('S1', 1), ('S2', 2)) c(slot, turn) ON h.format IS NOT NULL
  UNION ALL SELECT o.team_id, o.slot, row_number() OVER (PARTITION BY o.team_id ORDER BY o.place) FROM observed o JOIN entries e ON e.team_id = o.team_id JOIN happenings h ON h.event_id = e.event_id WHERE h.format IS NULL AND o.discipline = 'singles')
SELECT x.team_id, x.slot, q.player_id, CASE WHEN q.n > 0 THEN 'history' ELSE 'rating' END AS basis, coalesce(q.n, 0) AS support FROM slots x JOIN status t ON t.team_id = x.team_id AND t.status = 'predicted' LEFT JOIN queue q ON q.team_id = x.team_id AND q.turn = x.turn""")
def predicted_singles(s, d):
    """The singles courts of the predicted lineups."""
    return _plan(s, d).where("discipline = 'singles'").select("team_id", "slot", F.get("player_ids", F.lit(0)).alias("player_id"), "basis", "support")


def _eligible(s, d):
    """Available players of events with a format, with strength, singles matches on their own side and whether they play doubles only (every fourth)."""
    ours = written(_played(s, d), "played").where("ours")
    ranks = _ranks(s, d).select("team_id", "player_id", F.when(F.col("source").isin(catalog.INVERTED), -F.col("value")).otherwise(F.col("value")).alias("strength"))
    grid = catalog._grid(s, d).join(_courts(s, d).select("event_id").distinct(), "event_id", "leftsemi")
    e = grid.where("status = 'available'").join(ranks, ["team_id", "player_id"]).join(lineup.own_singles(ours), ["team_id", "player_id"], "left")
    e = e.select("team_id", "event_id", "day", "player_id", "strength", F.coalesce("matches", F.lit(0)).alias("singles"), (F.col("player_id") % 4 == 0).alias("doubles_only"))
    return grid, ours, e


@query(f"""{catalog._GRID}, latest AS (SELECT player_id, source, value FROM (SELECT *, row_number() OVER (PARTITION BY player_id, source ORDER BY observed_on DESC, rating_id DESC) AS k FROM ratings) x WHERE k = 1),
covered AS (SELECT p.team_id, l.source, count(*) AS covered FROM resolved p JOIN latest l ON l.player_id = p.player_id GROUP BY 1, 2),
best AS (SELECT team_id, source FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY covered DESC, CASE source {' '.join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(catalog.PRECEDENCE))} ELSE 9 END, source) AS k FROM covered) x WHERE k = 1)
SELECT g.team_id, g.event_id, g.day, count(CASE WHEN g.status = 'available' THEN 1 END) AS available, count(CASE WHEN g.status = 'unavailable' THEN 1 END) AS unavailable, count(CASE WHEN g.status = 'uncertain' THEN 1 END) AS uncertain, count(CASE WHEN g.status IS NULL THEN 1 END) AS unrecorded,
  count(CASE WHEN g.status = 'available' AND g.player_id % 4 <> 0 THEN 1 END) AS singles_eligible, count(CASE WHEN g.status = 'available' THEN l.value END) AS rated_eligible, CAST(6 AS BIGINT) AS bodies_needed, greatest(6 - count(CASE WHEN g.status = 'available' THEN 1 END), 0) AS shortfall
FROM grid g JOIN happenings h ON h.event_id = g.event_id AND h.format IS NOT NULL LEFT JOIN best b ON b.team_id = g.team_id LEFT JOIN latest l ON l.player_id = g.player_id AND l.source = b.source GROUP BY 1, 2, 3""")
def day_ledger(s, d):
    grid, _, eligible = _eligible(s, d)
    return lineup.day_ledger(grid, eligible, _courts(s, d))


def _scenarios(s, d):
    _, ours, eligible = _eligible(s, d)
    pairs = lineup.own_pairs(ours.where("discipline = 'doubles'")).groupBy("team_id", "low_id", "high_id").agg(F.sum("matches").alias("matches"))
    eligible, pairs = written(eligible, "eligible"), written(pairs, "pairs")
    return lineup.day_scenarios(eligible, pairs, _courts(s, d))


@query()
def day_scenarios(s, d):
    return _scenarios(s, d)


@query(f"{_OWN} SELECT team_id, count(DISTINCT CASE WHEN ours IS NOT NULL THEN match_id END) AS own_matches, count(DISTINCT CASE WHEN ours THEN match_id END) AS observed, count(DISTINCT CASE WHEN ours IS NOT NULL THEN match_id END) - count(DISTINCT CASE WHEN ours THEN match_id END) AS excluded_opposing_side FROM played GROUP BY 1")
def build_evidence(s, d):
    """Per team: its own matches, those in which a member stood on its side, and those in which none did."""
    return _played(s, d).groupBy("team_id").agg(
        F.count_distinct(F.when(F.col("ours").isNotNull(), F.col("match_id"))).alias("own_matches"), F.count_distinct(F.when(F.col("ours"), F.col("match_id"))).alias("observed")
    ).withColumn("excluded_opposing_side", F.col("own_matches") - F.col("observed"))
