"""Queries of keys, merges, candidates, failures and ladders, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.functions import keys, phrases
from rallyframe.operators import identity, ingest, merge
from rallyframe.plans import bind
from rallyframe.plans.registry import query


def _sql_loose(c: str) -> str:
    return f"CASE WHEN regexp_replace(lower({c}), '[^a-z0-9]', '', 'g') <> '' THEN 'raw:' || regexp_replace(lower({c}), '[^a-z0-9]', '', 'g') ELSE 'lit:' || trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')) END"


def _sql_time(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'null' WHEN regexp_matches(lower({c}), '^\\s*[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}\\s*[ap]\\.?m\\.?\\s*$')
  THEN 'clock:' || lpad(CAST(CAST(regexp_extract({c}, '[0-9]+') AS INTEGER) % 12 + CASE WHEN contains(lower({c}), 'p') THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' || regexp_extract({c}, ':\\s*([0-9]{{2}})', 1) ELSE {_sql_loose(c)} END"""


def _sql_site(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE {_sql_loose(c)} END"


@query(
    f"""SELECT o_orderkey, {_sql_time("t")} AS time_key FROM (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN ' TBD ' WHEN 1 THEN h || ':' || m || ' PM' WHEN 2 THEN h24 || ':' || m WHEN 3 THEN ' ' || h || ' : ' || m || ' am' WHEN 4 THEN h || ':' || m || 'a.m.'
  WHEN 5 THEN lpad(h, 2, '0') || ':' || m || 'P.M' WHEN 6 THEN ' - - ' WHEN 7 THEN h || ':' || m || ':30 am' END AS t
FROM (SELECT o_orderkey, CAST(o_orderkey % 13 AS VARCHAR) AS h, CAST(o_orderkey % 24 AS VARCHAR) AS h24, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS m FROM orders) x) y""",
    base=False,
)
def time_key(s, d):
    """Blanks about the colon, 12 and 24 hours, seconds, dots, other texts and nulls."""
    k = F.col("o_orderkey")
    minute, h = F.lpad((k % 60).cast("string"), 2, "0"), (k % 13).cast("string")
    texts = [F.lit(" TBD "), F.concat(h, F.lit(":"), minute, F.lit(" PM")), F.concat((k % 24).cast("string"), F.lit(":"), minute), F.concat(F.lit(" "), h, F.lit(" : "), minute, F.lit(" am")), F.concat(h, F.lit(":"), minute, F.lit("a.m."))]
    texts += [F.concat(F.lpad(h, 2, "0"), F.lit(":"), minute, F.lit("P.M")), F.lit(" - - "), F.concat(h, F.lit(":"), minute, F.lit(":30 am"))]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(k % 9 == i, t).otherwise(text)
    return bind.read(s, d, "orders").select("o_orderkey", keys.time_key(text).alias("time_key"))


@query(
    f"""SELECT p_partkey, {_sql_site("site")} AS site_key, regexp_replace(regexp_replace(lower(p_name || '  ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(trim(p_name)) AS name_key
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'St. ' || p_type || chr(39) || 's  #' || p_brand WHEN 1 THEN 'st ' || lower(p_type) || 's ' || p_brand WHEN 2 THEN ' -  #' END AS site FROM part) x""",
    base=False,
)
def text_keys(s, d):
    """Sites with and without points and apostrophes, of signs only, and null; names with invisible characters."""
    k = F.col("p_partkey") % 4
    site = F.when(k == 0, F.concat(F.lit("St. "), "p_type", F.lit("'s  #"), "p_brand")).when(k == 1, F.concat(F.lit("st "), F.lower("p_type"), F.lit("s "), "p_brand")).when(k == 2, " -  #")
    return bind.read(s, d, "part").select("p_partkey", keys.site_key(site).alias("site_key"), keys.slug(F.concat("p_name", F.lit("  "), "p_type")).alias("slug"), keys.name_key(F.concat(F.lit(" ​"), "p_name", F.lit("­\u0007 "))).alias("name_key"))


_FIXTURES = f""", keyed AS (SELECT *, least(home_team_id, visiting_team_id) AS low, greatest(home_team_id, visiting_team_id) AS high, home_team_id > visiting_team_id AS swap, {_sql_time("scheduled_time")} AS tk, {_sql_site("site")} AS sk FROM team_matches)"""


@query(f"""{_FIXTURES}, named AS (SELECT *, first_value(event_id IGNORE NULLS) OVER (PARTITION BY low, high, played_on, tk, sk ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept FROM keyed),
told AS (SELECT *, coalesce(event_id <> kept, false) AS refused FROM named),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY low, high, played_on, tk, sk ORDER BY match_id) AS f, count(*) OVER (PARTITION BY low, high, played_on, tk, sk) AS reports, bool_or(refused) OVER (PARTITION BY low, high, played_on, tk, sk) AS conflict FROM told) x WHERE f = 1),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY low, high, played_on, tk, sk ORDER BY match_id DESC) AS l FROM told WHERE NOT refused) x WHERE l = 1)
SELECT x.match_id, x.played_on, x.scheduled_time, x.site, x.kept AS event_id, x.home_team_id, x.visiting_team_id, CASE WHEN x.swap = y.swap THEN y.home_courts_won ELSE y.visiting_courts_won END AS home_courts_won,
  CASE WHEN x.swap = y.swap THEN y.visiting_courts_won ELSE y.home_courts_won END AS visiting_courts_won, x.reports, x.conflict
FROM firsts x JOIN lasts y ON x.low = y.low AND x.high = y.high AND x.played_on IS NOT DISTINCT FROM y.played_on AND x.tk = y.tk AND x.sk = y.sk""")
def merge_fixture_orientation(s, d):
    return merge.merge_fixtures(bind.team_matches(s, d))


@query("""SELECT match_id, CASE WHEN played_on IS NULL THEN 'no day' WHEN home_team_id = visiting_team_id THEN 'same team' ELSE 'kept' END AS outcome, 1 AS n FROM team_matches WHERE played_on IS NULL OR home_team_id = visiting_team_id""")
def broken_fixtures(s, d):
    """Fixtures that no scorecard can be attached to."""
    m = bind.team_matches(s, d).withColumn("outcome", F.when(F.col("played_on").isNull(), "no day").when(F.col("home_team_id") == F.col("visiting_team_id"), "same team"))
    return m.where("outcome IS NOT NULL").select("match_id", "outcome", F.lit(1).alias("n"))


@query(f"""{_FIXTURES}, tiers AS (SELECT a.match_id AS request, b.match_id AS m, b.match_id IS NOT NULL AND a.tk = b.tk AND a.sk = b.sk AS e, b.match_id IS NOT NULL AND (a.scheduled_time IS NULL OR b.scheduled_time IS NULL OR a.tk = b.tk) AND (a.site IS NULL OR b.site IS NULL OR a.sk = b.sk) AS l
  FROM (SELECT * FROM keyed WHERE match_id % 2 = 0) a LEFT JOIN (SELECT * FROM keyed WHERE match_id % 2 = 1) b ON a.played_on = b.played_on AND a.low = b.low AND a.high = b.high)
SELECT request, exact, lenient, CASE WHEN (CASE WHEN exact > 0 THEN exact ELSE lenient END) = 1 THEN coalesce(me, ml) END AS match_id, CASE CASE WHEN exact > 0 THEN exact ELSE lenient END WHEN 0 THEN 'new' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS outcome
FROM (SELECT request, count(CASE WHEN e THEN 1 END) AS exact, count(CASE WHEN l THEN 1 END) AS lenient, min(CASE WHEN e THEN m END) AS me, min(CASE WHEN l THEN m END) AS ml FROM tiers GROUP BY 1) x""")
def fixture_candidates(s, d):
    m = bind.team_matches(s, d)
    return ingest.fixture_candidates(m.where("match_id % 2 = 0").withColumnRenamed("match_id", "request"), m.where("match_id % 2 = 1"))


_SOURCED = """, stored AS (SELECT 'm' || (match_id // 3) AS source_match_id, event_id, home_team_id, visiting_team_id, played_on, home_courts_won, visiting_courts_won FROM team_matches WHERE match_id % 3 = 0),
fresh AS (SELECT * FROM (SELECT 'm' || (match_id // 4) AS source_match_id, event_id, home_team_id, visiting_team_id, played_on, home_courts_won, visiting_courts_won,
  row_number() OVER (PARTITION BY match_id // 4 ORDER BY match_id DESC) AS k FROM team_matches WHERE match_id % 3 <> 0 AND match_id % 11 <> 0) x WHERE k = 1)"""


@query(f"""{_SOURCED}
SELECT source_match_id, CASE WHEN se IS NOT NULL THEN se ELSE ie END AS event_id, CASE WHEN keep THEN sh ELSE ih END AS home_team_id, CASE WHEN keep THEN sv ELSE iv END AS visiting_team_id, CASE WHEN keep THEN sp ELSE ip END AS played_on,
  CASE WHEN keep THEN sa ELSE ia END AS home_courts_won, CASE WHEN keep THEN sb ELSE ib END AS visiting_courts_won, coalesce(se <> ie, false) AS conflict
FROM (SELECT coalesce(s.source_match_id, i.source_match_id) AS source_match_id, i.source_match_id IS NULL OR coalesce(s.event_id <> i.event_id, false) AS keep, s.event_id AS se, i.event_id AS ie, s.home_team_id AS sh, i.home_team_id AS ih, s.visiting_team_id AS sv,
  i.visiting_team_id AS iv, s.played_on AS sp, i.played_on AS ip, s.home_courts_won AS sa, i.home_courts_won AS ia, s.visiting_courts_won AS sb, i.visiting_courts_won AS ib FROM stored s FULL JOIN fresh i ON i.source_match_id = s.source_match_id) x""")
def merge_team_matches(s, d):
    """Stored matches have ids of one numbering, reports of another, so that some meet and some do not."""
    m, k = bind.team_matches(s, d), F.col("match_id")
    stored = m.where(k % 3 == 0).withColumn("source_match_id", F.concat(F.lit("m"), F.floor(k / 3).cast("string")))
    fresh = m.where(k % 3 != 0).withColumn("source_match_id", F.when(k % 11 != 0, F.concat(F.lit("m"), F.floor(k / 4).cast("string")))).withColumn("seen", k)
    return merge.merge_team_matches(stored, fresh)


@query(
    """SELECT s_suppkey AS player_id, CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) || ' ' ELSE s_name END AS name, CASE WHEN s_suppkey % 6 = 1 THEN NULL WHEN s_suppkey % 6 = 3 THEN '18+' ELSE CAST(s_nationkey AS VARCHAR) END AS age_range,
  lower(trim(CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) || ' ' ELSE s_name END)) AS name_key FROM supplier""",
    base=False,
)
def merge_players(s, d):
    """A quarter of the players get another name, a sixth each another age range and none; the rest is not told."""
    p = bind.read(s, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("age_range"), F.lower("s_name").alias("name_key"))
    k = F.col("player_id")
    name = F.struct((k % 4 == 1).alias("given"), F.concat(F.upper("name"), F.lit(" ")).alias("value"))
    age = F.struct((k % 6).isin(1, 3).alias("given"), F.when(k % 6 == 3, "18+").alias("value"))
    return merge.merge_players(p, p.where("player_id % 5 < 4 OR player_id % 4 = 1 OR player_id % 6 IN (1, 3)").select("player_id", name.alias("name"), age.alias("age_range")))


_COURTS = """, stored AS (SELECT CASE WHEN match_id % 2 = 0 THEN 'c' || (match_id // 6) END AS source_match_id, slot, played_on, match_id // 8 AS team_match_id, discipline, winner_side, '6-' || (match_id % 5) AS score, CAST(NULL AS VARCHAR) AS league_context, -1 AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY match_id % 2, CASE WHEN match_id % 2 = 0 THEN match_id // 6 ELSE match_id // 8 END, slot, CASE WHEN match_id % 2 = 1 THEN played_on END ORDER BY match_id) AS k FROM court_matches WHERE match_id % 5 < 3) x WHERE k = 1),
fresh AS (SELECT CASE WHEN match_id % 2 = 0 THEN 'c' || (match_id // 6) END, slot, played_on, match_id // 8, discipline, winner_side, '4-' || (match_id % 5), 'pull', match_id FROM court_matches WHERE match_id % 5 >= 2)"""


@query(f"""{_COURTS} SELECT source_match_id, slot, played_on, team_match_id, discipline, winner_side, score, league_context FROM (SELECT *, row_number() OVER (PARTITION BY source_match_id, slot, CASE WHEN source_match_id IS NULL THEN played_on END,
  CASE WHEN source_match_id IS NULL THEN team_match_id END ORDER BY seen DESC) AS r FROM (SELECT * FROM stored UNION ALL SELECT * FROM fresh) x) y WHERE r = 1""")
def merge_courts(s, d):
    k = F.col("match_id")
    m = bind.court_matches(s, d).withColumn("source_match_id", F.when(k % 2 == 0, F.concat(F.lit("c"), F.floor(k / 6).cast("string")))).withColumn("team_match_id", F.floor(k / 8))
    place = Window.partitionBy("source_match_id", "slot", F.when(k % 2 == 1, F.col("played_on")), F.when(k % 2 == 1, F.col("team_match_id"))).orderBy("match_id")
    stored = m.where(k % 5 < 3).withColumn("k", F.row_number().over(place)).where("k = 1").withColumn("score", F.concat(F.lit("6-"), (k % 5).cast("string"))).withColumn("league_context", F.lit(None).cast("string"))
    return merge.merge_courts(stored, m.where(k % 5 >= 2).withColumn("score", F.concat(F.lit("4-"), (k % 5).cast("string"))).withColumn("league_context", F.lit("pull")).withColumn("seen", k))


@query("SELECT match_id, player_id, CASE WHEN match_id % 3 = 0 THEN CASE side WHEN 'O' THEN 'F' ELSE 'O' END ELSE side END AS side FROM participants")
def merge_participants(s, d):
    """A later report of a third of the matches puts everyone on the other side; nobody is deleted."""
    p = bind.participants(s, d).withColumn("seen", F.lit(0))
    later = p.where("match_id % 3 = 0").withColumn("side", F.when(F.col("side") == "O", "F").otherwise("O")).withColumn("seen", F.lit(1))
    return merge.merge_latest(p, later, ["match_id", "player_id"], ["seen"]).drop("seen")


_FAILED = """(SELECT event_id, user_id, CASE event_id % 12 WHEN 0 THEN 'permanent' WHEN 1 THEN 'permanent' WHEN 2 THEN 'retryable' WHEN 3 THEN CASE WHEN st IN (408, 425, 429) OR st BETWEEN 500 AND 599 THEN 'retryable' ELSE 'permanent' END
  WHEN 5 THEN 'retryable' WHEN 7 THEN 'retryable' WHEN 9 THEN 'permanent' WHEN 10 THEN 'retryable' ELSE 'unclassified' END AS disposition FROM (SELECT event_id, user_id, 400 + event_id // 12 % 202 AS st FROM events) x)"""


def _failures(s, d):
    """Chains of causes of twelve shapes: fetches that ended in 200, 302, 425, 400 to 601 and without a status; a cause at place 2, 17 and 16; codes, names and kinds."""
    k = F.col("event_id") % 12

    def link(kind="Error", status=None, name=None, code=None):
        status = F.lit(None) if status is None else status
        return F.struct(F.lit(kind).alias("kind"), status.cast("double").alias("status"), F.lit(name).cast("string").alias("name"), F.lit(code).cast("string").alias("code"))

    bare = link()
    status = F.when(k == 0, 200).when(k == 1, 302).when(k == 2, 425).when(k == 3, 400 + F.floor(F.col("event_id") / 12) % 202)
    chain = F.when(k < 5, F.array(link("FetchError", status))).when(k == 5, F.array(bare, link(code="ECONNRESET"))).when(k == 6, F.concat(F.array_repeat(bare, 16), F.array(link(code="ECONNRESET"))))
    chain = chain.when(k == 7, F.concat(F.array_repeat(bare, 15), F.array(link(code="SQLITE_BUSY_SNAPSHOT")))).when(k == 8, F.array(link(code="SQLITE_LOCKED_VTAB"))).when(k == 9, F.array(bare, link("ParseError"))).when(k == 10, F.array(link(name="TimeoutError"), link("ParseError"))).otherwise(F.array(link(code="ENOTFOUND")))
    return bind.read(s, d, "events").select("event_id", "user_id", ingest.disposition(chain).alias("disposition"))


@query(f"SELECT event_id, disposition FROM {_FAILED} y", base=False)
def failure_dispositions(s, d):
    return _failures(s, d).select("event_id", "disposition")


@query(f"SELECT user_id, count(CASE WHEN disposition = 'retryable' THEN 1 END) AS retryable, count(CASE WHEN disposition = 'permanent' THEN 1 END) AS permanent, count(CASE WHEN disposition = 'unclassified' THEN 1 END) AS unclassified FROM {_FAILED} y GROUP BY 1", base=False)
def skip_reason_counts(s, d):
    return ingest.skip_counts(_failures(s, d), "user_id")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female' WHEN 5 THEN 'Male' END AS gender, CASE c_custkey % 6 WHEN 0 THEN 'Male' WHEN 5 THEN 'Male' ELSE 'Female' END AS stored FROM customer""", base=False)
def genders(s, d):
    said = F.get(F.array(*[F.lit(x) for x in ("MALE", " female ", "Competition Category:  Female", "M", None, "competition category:male")]), F.col("c_custkey") % 6)
    return bind.read(s, d, "customer").select("c_custkey", phrases.gender(said).alias("gender"), phrases.gender_to_write(F.lit("Female"), said).alias("stored"))


# Ladders: parts stand for players, every fifth with an alias, all with source ids; brands stand for teams.
_LADDER = """, stored AS (SELECT p_partkey AS id, lower(trim(p_name)) || ' ' || p_brand AS name, lower(trim(p_name) || ' ' || p_brand) AS key, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey END AS first_id, CASE WHEN p_partkey % 4 = 0 THEN 'w' || (p_partkey // 8) END AS second_id, p_partkey % 40 AS team_id FROM part),
known AS (SELECT key, id, team_id FROM stored UNION SELECT 'aka ' || key, id, team_id FROM stored WHERE id % 5 = 0),
asked AS (SELECT id AS request, CASE WHEN id % 6 = 0 THEN 'u' || (id + id % 4) END AS first_id, CASE WHEN id % 8 = 1 THEN 'w' || (id // 8) END AS second_id, team_id,
  CASE id % 5 WHEN 0 THEN 'aka ' || key WHEN 1 THEN key WHEN 2 THEN key || 'x' WHEN 3 THEN substr(key, 3) ELSE 'nobody ' || id || ' at all' END AS key FROM stored),
by_first AS (SELECT a.request, count(*) AS n, min(s.id) AS id FROM asked a JOIN stored s ON s.first_id = a.first_id GROUP BY 1),
by_second AS (SELECT a.request, count(*) AS n, min(s.id) AS id FROM asked a JOIN stored s ON s.second_id = a.second_id GROUP BY 1)"""


def _ladder(s, d):
    p = bind.read(s, d, "part").select(F.col("p_partkey").alias("id"), keys.ascii_name_key(F.concat(F.trim("p_name"), F.lit(" "), "p_brand")).alias("key"))
    k = F.col("id")
    stored = p.select("id", "key", F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("first_id"), F.when(k % 4 == 0, F.concat(F.lit("w"), F.floor(k / 8).cast("string"))).alias("second_id"), (k % 40).alias("team_id"))
    aliases = stored.where("id % 5 = 0").select(F.concat(F.lit("aka "), "key").alias("key"), "id")
    name = F.when(k % 5 == 0, F.concat(F.lit("aka "), "key")).when(k % 5 == 1, F.col("key")).when(k % 5 == 2, F.concat("key", F.lit("x"))).when(k % 5 == 3, F.expr("substring(key, 3)")).otherwise(F.concat(F.lit("nobody "), k.cast("string"), F.lit(" at all")))
    asked = stored.select(k.alias("request"), F.when(k % 6 == 0, F.concat(F.lit("u"), (k + k % 4).cast("string"))).alias("first_id"), F.when(k % 8 == 1, F.concat(F.lit("w"), F.floor(k / 8).cast("string"))).alias("second_id"), "team_id", name.alias("key"))
    return asked, stored, aliases


_NEAR = "JOIN (SELECT DISTINCT key FROM stored) b ON abs(length(a.key) - length(b.key)) <= 2 AND levenshtein(a.key, b.key) BETWEEN 1 AND 2"


@query(f"""{_LADDER}, exact AS (SELECT a.request, count(DISTINCT k.id) AS n, min(k.id) AS id FROM asked a JOIN known k ON k.key = a.key GROUP BY 1),
near AS (SELECT a.key, count(DISTINCT b.key) AS n FROM (SELECT DISTINCT key FROM asked) a {_NEAR} GROUP BY 1)
SELECT a.request, CASE WHEN f.n > 0 OR s.n > 0 THEN 'source-id' WHEN e.n = 1 THEN 'name' WHEN e.n > 1 THEN 'name' WHEN r.n > 0 THEN 'near' ELSE 'none' END AS tier,
  CASE WHEN f.n > 0 OR s.n > 0 OR e.n = 1 THEN 'matched' WHEN e.n > 1 OR r.n > 0 THEN 'ambiguous' ELSE 'created' END AS outcome, CASE WHEN f.n > 0 THEN f.id WHEN s.n > 0 THEN s.id WHEN e.n = 1 THEN e.id END AS id
FROM asked a LEFT JOIN by_first f ON f.request = a.request LEFT JOIN by_second s ON s.request = a.request LEFT JOIN exact e ON e.request = a.request LEFT JOIN near r ON r.key = a.key""")
def player_ladder(s, d):
    asked, stored, aliases = _ladder(s, d)
    return identity.player_ladder(asked, stored, aliases, ["first_id", "second_id"])


@query(f"""{_LADDER}, exact AS (SELECT a.request, count(DISTINCT k.id) AS n, min(k.id) AS id FROM asked a JOIN known k ON k.key = a.key AND k.team_id = a.team_id GROUP BY 1),
near AS (SELECT a.team_id, a.key, count(DISTINCT b.id) AS n FROM (SELECT DISTINCT team_id, key FROM asked) a JOIN stored b ON b.team_id = a.team_id AND abs(length(a.key) - length(b.key)) <= 2 AND levenshtein(a.key, b.key) BETWEEN 1 AND 2 GROUP BY 1, 2)
SELECT a.request, CASE WHEN e.n = 1 THEN 'matched' WHEN e.n > 1 OR r.n > 0 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, CASE WHEN e.n = 1 THEN e.id END AS id
FROM asked a LEFT JOIN exact e ON e.request = a.request LEFT JOIN near r ON r.team_id = a.team_id AND r.key = a.key""")
def roster_ladder(s, d):
    """Names looked for within one team's roster only; nothing is ever created."""
    asked, stored, aliases = _ladder(s, d)
    return identity.roster_ladder(asked, stored, aliases, stored.select("team_id", F.col("id").alias("player_id")))


@query(f"""{_LADDER}, wanted AS (SELECT request, CASE WHEN request % 2 = 0 THEN 'usta:' || coalesce('u' || (request + request % 4), '') WHEN request % 3 = 0 THEN 'wtn:w' || (request // 8) ELSE key END AS target, team_id FROM asked),
split AS (SELECT *, CASE WHEN starts_with(target, 'usta:') THEN 'first' WHEN starts_with(target, 'wtn:') THEN 'second' ELSE 'name' END AS kind FROM wanted),
hits AS (SELECT w.request, count(*) AS n, min(s.id) AS id, count(CASE WHEN s.team_id = w.team_id THEN 1 END) AS inside, min(CASE WHEN s.team_id = w.team_id THEN s.id END) AS ours FROM split w JOIN stored s ON (w.kind = 'first' AND s.first_id = substr(w.target, 6)) OR (w.kind = 'second' AND s.second_id = substr(w.target, 5)) GROUP BY 1)
SELECT w.request, w.kind, CASE WHEN h.n IS NULL THEN 'unresolved' WHEN h.inside > 1 THEN 'ambiguous' WHEN h.inside = 1 THEN 'matched' ELSE 'off-roster' END AS outcome, CASE WHEN h.inside = 1 THEN h.ours END AS id FROM split w LEFT JOIN hits h ON h.request = w.request WHERE w.kind <> 'name'""")
def target_routes(s, d):
    """Targets by source id, and whether who they name is on the roster that was asked for."""
    asked, stored, _ = _ladder(s, d)
    r = F.col("request")
    target = F.when(r % 2 == 0, F.concat(F.lit("usta:u"), (r + r % 4).cast("string"))).when(r % 3 == 0, F.concat(F.lit("wtn:w"), F.floor(r / 8).cast("string"))).otherwise(F.col("key"))
    routed = identity.routed(asked.select("request", "team_id", target.alias("target")), {"usta:": "first_id", "wtn:": "second_id"})
    out = identity.roster_members_by_id(routed, stored, stored.select("team_id", F.col("id").alias("player_id")))
    return out.select("request", F.when(F.col("route") == "first_id", "first").otherwise("second").alias("kind"), "outcome", "id")


@query(f"""{_LADDER}, t AS (SELECT id, CASE WHEN id % 10 = 0 THEN upper(key) ELSE key END AS name, key FROM stored), ids AS (SELECT key, count(DISTINCT name) AS n, min(id) AS id FROM t GROUP BY 1),
near AS (SELECT a.key, count(DISTINCT b.key) AS n FROM (SELECT DISTINCT key FROM asked) a {_NEAR} GROUP BY 1), teams2 AS (SELECT key, name, min(id) AS id FROM t GROUP BY 1, 2), e AS (SELECT key, count(*) AS n, min(id) AS id FROM teams2 GROUP BY 1)
SELECT a.request, CASE WHEN e.n = 1 THEN 'matched' WHEN e.n > 1 OR r.n > 0 THEN 'ambiguous' ELSE 'created' END AS outcome, CASE WHEN e.n = 1 THEN e.id END AS id FROM asked a LEFT JOIN e ON e.key = a.key LEFT JOIN near r ON r.key = a.key""")
def team_ladder(s, d):
    """Team names are unique as written, not by key: two that share a key are ambiguous."""
    asked, stored, _ = _ladder(s, d)
    name = F.when(F.col("id") % 10 == 0, F.upper("key")).otherwise(F.col("key"))
    teams = stored.select("id", "key", name.alias("name")).groupBy("key", "name").agg(F.min("id").alias("id"))
    return identity.team_ladder(asked.select("request", "key"), teams)


@query(f"""{_FIXTURES}, cards AS (SELECT match_id AS card, home_team_id, CASE WHEN match_id % 29 = 0 THEN home_team_id ELSE visiting_team_id END AS visiting_team_id, played_on, scheduled_time, site, tk, sk, least(home_team_id, CASE WHEN match_id % 29 = 0 THEN home_team_id ELSE visiting_team_id END) AS low,
  greatest(home_team_id, CASE WHEN match_id % 29 = 0 THEN home_team_id ELSE visiting_team_id END) AS high, CASE match_id % 6 WHEN 4 THEN 'AFRICA' WHEN 2 THEN 'No such event' END AS event_name FROM keyed WHERE match_id % 2 = 0 AND played_on IS NOT NULL),
seats AS (SELECT m.match_id AS card, m.slot, p.player_id, p.side, q.team_id, CASE WHEN p.side = 'O' THEN c.home_team_id ELSE c.visiting_team_id END AS wanted_team FROM court_matches m JOIN participants p ON p.match_id = m.match_id JOIN players q ON q.player_id = p.player_id JOIN cards c ON c.card = m.match_id),
off AS (SELECT card, count(CASE WHEN player_id % 4 = 0 AND team_id <> wanted_team THEN 1 END) AS off, count(CASE WHEN player_id % 50 = 0 THEN 1 END) AS doubled FROM seats GROUP BY 1),
happen AS (SELECT event_name, event_id FROM happenings),
par AS (SELECT a.card, count(CASE WHEN a.tk = b.tk AND a.sk = b.sk THEN 1 END) AS e, count(CASE WHEN (a.scheduled_time IS NULL OR b.scheduled_time IS NULL OR a.tk = b.tk) AND (a.site IS NULL OR b.site IS NULL OR a.sk = b.sk) THEN 1 END) AS l,
  min(CASE WHEN a.tk = b.tk AND a.sk = b.sk THEN b.match_id END) AS me, min(CASE WHEN (a.scheduled_time IS NULL OR b.scheduled_time IS NULL OR a.tk = b.tk) AND (a.site IS NULL OR b.site IS NULL OR a.sk = b.sk) THEN b.match_id END) AS ml
  FROM cards a JOIN (SELECT * FROM keyed WHERE match_id % 2 = 1) b ON a.played_on = b.played_on AND a.low = b.low AND a.high = b.high GROUP BY 1)
SELECT c.card, CASE WHEN c.card % 31 = 0 THEN 'duplicate-slots' WHEN c.card % 37 = 0 THEN 'unknown-team' WHEN c.home_team_id = c.visiting_team_id THEN 'same-team' WHEN c.event_name IS NOT NULL AND h.event_id IS NULL THEN 'unknown-event' WHEN coalesce(o.off, 0) > 0 THEN 'unresolved-players'
  WHEN coalesce(o.doubled, 0) > 0 THEN 'duplicate-players' WHEN CASE WHEN coalesce(p.e, 0) > 0 THEN p.e ELSE coalesce(p.l, 0) END > 1 THEN 'ambiguous-parent-match' WHEN t.event_id IS NOT NULL AND h.event_id IS NOT NULL AND t.event_id <> h.event_id THEN 'conflicting-parent-event' ELSE 'accepted' END AS outcome
FROM cards c LEFT JOIN happen h ON h.event_name = c.event_name LEFT JOIN off o ON o.card = c.card LEFT JOIN par p ON p.card = c.card
LEFT JOIN team_matches t ON t.match_id = CASE WHEN p.e = 1 THEN p.me WHEN coalesce(p.e, 0) = 0 AND p.l = 1 THEN p.ml END""")
def scorecard_outcomes(s, d):
    """Scorecards made of the even matches, with faults of all eight kinds, against the odd ones."""
    m, k = bind.team_matches(s, d), F.col("match_id")
    cards = m.where("match_id % 2 = 0 AND played_on IS NOT NULL").select(
        k.alias("card"), "played_on", "scheduled_time", "site", "home_team_id", F.when(k % 29 == 0, F.col("home_team_id")).otherwise(F.col("visiting_team_id")).alias("visiting_team_id"),
        F.when(k % 6 == 4, "AFRICA").when(k % 6 == 2, "No such event").alias("event_name"), (k % 31 == 0).alias("slot_twice"), (k % 37 != 0).alias("teams_known"),
    )
    seats = bind.match_players(s, d).select(F.col("match_id").alias("card"), "slot", "player_id", "side").join(bind.players(s, d).select("player_id", "team_id"), "player_id")
    seats = seats.join(cards.select("card", "home_team_id", "visiting_team_id"), "card")
    wanted = F.when(F.col("side") == "O", F.col("home_team_id")).otherwise(F.col("visiting_team_id"))
    seats = seats.select("card", "slot", "player_id", (~((F.col("player_id") % 4 == 0) & (F.col("team_id") != wanted))).alias("on_roster"), F.when(F.col("player_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"))
    seats = seats.select("card", "slot", "player_id", "on_roster", F.explode("times").alias("t")).drop("t")
    return ingest.scorecard_outcomes(cards, seats, bind.events(s, d).select("event_name", "event_id"), m.where("match_id % 2 = 1"))
