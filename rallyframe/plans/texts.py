"""Queries of printed texts and of how players play, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.functions import grammar
from rallyframe.operators import lineup, printed, upkeep
from rallyframe.plans import bind, lineups
from rallyframe.plans.registry import query
from rallyframe.sources.store import written

_ALIASES = """WITH a AS (SELECT s_suppkey AS player_id, s_suppkey * 10 + k AS alias_id, CASE k WHEN 0 THEN upper(s_name) WHEN 1 THEN 'aka ' || s_name WHEN 2 THEN 'AKA ' || upper(s_name) || ' ' ELSE 'x' || (s_suppkey % 7) END AS alias, lower(s_name) AS own FROM supplier, (SELECT unnest(range(4)) AS k) r WHERE (s_suppkey + k) % 3 <> 0),
d AS (SELECT player_id, lower(trim(alias)) AS key, arg_min(alias, alias_id) AS alias, min(alias_id) AS alias_id FROM a WHERE lower(trim(alias)) <> own GROUP BY 1, 2)
SELECT player_id, string_agg(alias, ', ' ORDER BY alias_id) AS text FROM d GROUP BY 1"""


@query(_ALIASES, base=False)
def alias_texts(s, d):
    """Each player's aliases on one line; those that are one name in other spelling are printed once."""
    k = F.col("s_suppkey")
    p = bind.read(s, d, "supplier")
    many = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where((k + F.col("k")) % 3 != 0)
    alias = F.when(F.col("k") == 0, F.upper("s_name")).when(F.col("k") == 1, F.concat(F.lit("aka "), "s_name")).when(F.col("k") == 2, F.concat(F.lit("AKA "), F.upper("s_name"), F.lit(" "))).otherwise(F.concat(F.lit("x"), (k % 7).cast("string")))
    return printed.alias_lines(p.select(k.alias("player_id"), F.col("s_name").alias("name")), many.select(k.alias("player_id"), (k * 10 + F.col("k")).alias("alias_id"), alias.alias("alias")))


@query(
    """WITH f AS (SELECT n_regionkey AS region, n_nationkey AS place, '"' || n_name || '" (team) — near: ' || n_name || 'S, ' || lower(n_name) AS fact FROM nation WHERE n_nationkey % 3 = 0)
SELECT region, CASE WHEN count(*) = 1 THEN 'ambiguous identity ' || min(fact) ELSE count(*) || ' ambiguous identities — ' || string_agg('[' || k || '] ' || fact, '; ' ORDER BY place) END AS text FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY place) AS k FROM f) x GROUP BY 1""",
    base=False,
)
def ambiguity_texts(s, d):
    """What is ambiguous of each region on one line, numbered where there are several."""
    n = bind.read(s, d, "nation").where("n_nationkey % 3 = 0")
    found = n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("incoming"), F.lit("team").alias("context"), F.array(F.concat("n_name", F.lit("S")), F.lower("n_name")).alias("candidates"))
    return printed.ambiguity_lines(found, "region")


def _plays(s, d):
    p, k = bind.players(s, d), F.col("player_id")
    said = F.when(k % 4 == 0, "both").when(k % 4 == 1, "doubles-only").when(k % 4 == 2, "Both")
    outcome = F.when(k % 11 == 0, "ambiguous").when(k % 13 == 0, "created").otherwise("matched")
    requests = p.select(k.alias("request"), F.when(k % 5 == 0, (F.col("team_id") + 1) % 25).otherwise(F.col("team_id")).cast("int").alias("team_id"), said.alias("plays"), outcome.alias("outcome"), F.when(outcome == "matched", k).alias("id"))
    return p, upkeep.plays_outcomes(requests, bind.memberships(s, d).where("NOT retired"))


_PLAYS = """, asked AS (SELECT player_id AS request, CASE WHEN player_id % 5 = 0 THEN (team_id + 1) % 25 ELSE team_id END AS team_id, CASE player_id % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'doubles-only' WHEN 2 THEN 'Both' END AS plays FROM players),
said AS (SELECT request, plays, CASE WHEN plays IS NULL OR plays NOT IN ('both', 'doubles-only') THEN 'invalid value' WHEN request % 11 = 0 THEN 'ambiguous' WHEN request % 13 = 0 THEN 'unknown player'
  WHEN NOT EXISTS (SELECT 1 FROM memberships m WHERE NOT m.retired AND m.player_id = a.request AND m.team_id = a.team_id) THEN 'not on the roster' ELSE 'set' END AS outcome FROM asked a)"""


@query(f"{_PLAYS} SELECT request, outcome, CASE WHEN outcome = 'set' THEN request END AS player_id, CASE WHEN outcome = 'set' THEN plays END AS plays FROM said")
def plays_outcomes(s, d):
    """What becomes of requests to say how a player plays, with faults of each kind."""
    return _plays(s, d)[1]


@query(f"{_PLAYS} SELECT p.player_id, CASE WHEN s.outcome = 'set' THEN s.plays WHEN p.player_id % 2 = 0 THEN 'old' END AS plays FROM players p LEFT JOIN said s ON s.request = p.player_id")
def plays_after(s, d):
    """How players play after those requests."""
    players, outcomes = _plays(s, d)
    return upkeep.set_plays(players.select("player_id", F.when(F.col("player_id") % 2 == 0, "old").alias("plays")), outcomes)


@query("SELECT c_custkey AS player_id, CASE c_custkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN c_mktsegment WHEN 4 THEN NULL ELSE 'Female' END AS gender FROM customer", base=False)
def backfilled_genders(s, d):
    k = F.col("c_custkey")
    said = F.when(k % 6 == 0, "Competition Category: MALE").when(k % 6 == 1, " female ").when(k % 6 == 2, "Male").when(k % 6 == 3, F.col("c_mktsegment")).when(k % 6 == 5, "FEMALE")
    return upkeep.backfilled_genders(bind.read(s, d, "customer").select(k.alias("player_id"), said.alias("gender")))


@query()
def lineup_texts(s, d):
    """The predicted lineup of each team as it is printed."""
    e = lineups._evidence(s, d)
    predicted = written(lineups._plan(s, d, e).join(e.slots.select("team_id", "slot", "place"), ["team_id", "slot"]), "predicted")
    status = e.status.join(bind.events(s, d).select("event_id", "event_name"), "event_id")
    unplaced = lineup.unplaced(predicted, e.members.select("team_id", "player_id"), e.own)
    current = bind.memberships(s, d).where("NOT retired")
    sizes = current.groupBy("team_id").agg(F.count("event_id").alias("registered"), F.count(F.when(F.col("event_id").isNull(), 1)).alias("season"))
    return printed.lineup_texts(predicted, bind.teams(s, d), bind.players(s, d), status, unplaced, e.ranks, sizes)


_SCOPES = (
    '{"mode":"exclude","prefixes":["§"]}', '{"prefixes": ["§", "Tri"], "mode": "only"}', '{"mode":"exclude","prefixes":["§","§ "]}', '{"mode":"exclude","prefixes":["§"],"x":1}', '{"mode":"none","prefixes":["§"]}', '{"mode":"only","prefixes":[]}', '{"mode":"only","prefixes":[7]}',
    '{"mode":"only","prefixes":["§","x§"', '["§"]', '{"mode":"only","prefixes":["a,§"]}', '{"mode":"only","prefixes":[" §"]}', '{"mode":"only","prefixes":["§",""]}', None,
)
_RAW = "CASE o_orderkey % 13 " + " ".join(f"WHEN {k} THEN replace('{t}', '§', coalesce(c_mktsegment, 'none'))" for k, t in enumerate(_SCOPES) if t) + " END"


@query(
    f"""WITH r AS (SELECT o_orderkey, o_orderkey % 13 AS k, {_RAW} AS raw FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS j FROM r),
t AS (SELECT *, j IS NOT NULL AND json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['mode', 'prefixes'] AND json_type(j, '$.mode') = 'VARCHAR' AND json_type(j, '$.prefixes') = 'ARRAY' AND json_array_length(j, '$.prefixes') > 0 AND list_distinct(json_type(j, '$.prefixes[*]')) = ['VARCHAR'] AS typed FROM j),
p AS (SELECT *, CASE WHEN typed THEN json_extract_string(j, '$.mode') END AS mode, CASE WHEN typed THEN json_extract_string(j, '$.prefixes[*]') END AS prefixes FROM t),
e AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN j IS NULL THEN 'not JSON' WHEN NOT typed OR mode NOT IN ('exclude', 'only') OR list_contains(prefixes, '') THEN 'malformed'
  WHEN len(list_distinct([lower(trim(x)) FOR x IN prefixes])) < len(prefixes) THEN 'prefix given twice' WHEN len([x FOR x IN prefixes IF x <> trim(x) OR contains(x, ',')]) > 0 THEN 'not canonical' END AS error FROM p)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN mode END AS mode, CASE WHEN error IS NULL THEN array_to_string(prefixes, '|') END AS prefixes FROM e""",
    base=False,
)
def stored_scopes(s, d):
    """Stored league scopes: read, or refused for what is wrong with them."""
    o = bind.read(s, d, "orders").join(bind.read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    stored = grammar.stored_scope(F.col("raw"))
    return o.select("o_orderkey", F.expr(_RAW).alias("raw")).select("o_orderkey", stored.alias("s")).select("o_orderkey", "s.error", "s.mode", F.array_join("s.prefixes", "|").alias("prefixes"))
