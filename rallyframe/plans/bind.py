"""The match relations, bound to the test tables.

Operators know only the relations' column names; this module derives those relations from the
generated tables, by DataFrame functions alone. ``SQL_BASE`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = "2001-08-01"
REGISTERED_UNTIL = "2024-01-03"
FIRST_DAY = "2024-01-01"
TIMES = (None, "9:00 AM", "09:00am", " 9 : 00 a.m. ", "17:00", "5:00 p.m", "TBD")
SITES = (None, "St. Mary's", "st marys", "--", "Court 7")


def _sql_choice(values: tuple, column: str) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({column} % {len(values)} AS INTEGER) + 1)"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def players(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team_id"))


def teams(spark, d):
    region = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("district"))
    return read(spark, d, "nation").join(region, "n_regionkey", "left").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), "district")


def court_matches(spark, d):
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate")).alias("played_on"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("winner_side"),
        F.concat(F.when(number <= 2, "S").otherwise("D"), number.cast("string")).alias("slot"),
        F.when(number <= 2, "singles").otherwise("doubles").alias("discipline"),
        "o_custkey",
    )


def participants(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id")).agg(F.min("l_linestatus").alias("side"))


def match_players(spark, d):
    """One row for each match and participant."""
    return court_matches(spark, d).drop("o_custkey").join(participants(spark, d), "match_id")


def match_seats(spark, d):
    """``match_players`` for what joins by match again: the large table is dealt by match before all else, to as many tasks as are set, and only then."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"), "l_linestatus").repartition(tasks, "match_id")
    return court_matches(spark, d).drop("o_custkey").join(dealt.groupBy("match_id", "player_id").agg(F.min("l_linestatus").alias("side")), "match_id")


def leagues(spark, d):
    """match_id and league_context (null for some)."""
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return court_matches(spark, d).join(customer, "o_custkey", "left").select("match_id", F.when(F.col("match_id") % 23 != 0, F.col("c_mktsegment")).alias("league_context"))


def match_sides(spark, d):
    """match_id and the two teams: ``team_matches`` without counts."""
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_team_id"))
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), "o_custkey").join(customer, "o_custkey")
    return m.select("match_id", "home_team_id", ((F.col("home_team_id") + 1 + F.col("match_id") % 24) % 25).cast("int").alias("visiting_team_id"))


def team_matches(spark, d):
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_team_id"))
    flags = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("a"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    m = court_matches(spark, d).join(customer, "o_custkey").join(flags, "match_id", "left")
    known = F.col("match_id") % 19 != 0
    return m.select(
        "match_id", "played_on", "home_team_id", ((F.col("home_team_id") + 1 + F.col("match_id") % 24) % 25).cast("int").alias("visiting_team_id"),
        F.when(known, F.col("a")).alias("home_courts_won"), F.when(known, F.col("r")).alias("visiting_courts_won"),
        F.get(F.array(*map(F.lit, TIMES)), F.col("match_id") % len(TIMES)).alias("scheduled_time"), F.get(F.array(*map(F.lit, SITES)), F.col("match_id") % len(SITES)).alias("site"),
        F.when(F.col("match_id") % 7 == 3, 1).when(F.col("match_id") % 7 == 5, 2).alias("event_id"),
    )


def ratings(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("rating_id"), F.col("user_id").alias("player_id"), F.col("event_type").alias("source"), "value", F.to_date("ts").alias("observed_on"))


def availability(spark, d):
    """player_id, day and status: the day's last event says which; a signup leaves no row."""
    e = read(spark, d, "events").select(F.col("user_id").alias("player_id"), F.to_date("ts").alias("day"), F.struct("ts", "event_id", "event_type").alias("e"))
    last = e.groupBy("player_id", "day").agg(F.max("e").alias("e")).select("player_id", "day", F.col("e.event_type").alias("t"))
    status = F.when(F.col("t").isin("view", "click"), "available").when(F.col("t") == "purchase", "uncertain").when(F.col("t") == "error", "unavailable")
    return last.select("player_id", "day", status.alias("status")).where("status IS NOT NULL")


def events(spark, d):
    """One event for each region, for the teams of its nations: ten days from the first of the month, each six days after the one before; each second one has a format."""
    k = F.col("r_regionkey")
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), k * 6)
    courts = F.when(k % 2 == 0, "S1:singles,S2:singles,D3:doubles,D4:doubles")
    return read(spark, d, "region").select((k + 1).cast("int").alias("event_id"), F.col("r_name").alias("event_name"), start.alias("starts_on"), F.date_add(start, 9).alias("ends_on"), courts.alias("format"))


def entries(spark, d):
    """team_id and event_id: the teams of a region play in its event."""
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), (F.col("n_regionkey") + 1).cast("int").alias("event_id"))


def memberships(spark, d):
    """player_id, team_id, event_id (null: season), retired: each player's season row, and a row for the team's event of those seen early in the month in teams below 20."""
    early = read(spark, d, "events").where((F.col("event_type") == "purchase") & (F.to_date("ts") <= F.lit(REGISTERED_UNTIL).cast("date"))).select(F.col("user_id").alias("player_id")).distinct()
    p = players(spark, d).select("player_id", "team_id")
    season = p.select("*", F.lit(None).cast("int").alias("event_id"), (F.col("player_id") % 13 == 0).alias("retired"))
    registered = p.where("team_id < 20").join(early, "player_id", "leftsemi").join(entries(spark, d), "team_id")
    return season.union(registered.select("player_id", "team_id", "event_id", F.lit(False)))


SQL_BASE = f"""
WITH players AS (SELECT s_suppkey AS player_id, s_name AS name, s_nationkey AS team_id FROM supplier),
court_matches AS (
  SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS played_on,
         nullif(o_orderstatus, 'P') AS winner_side,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'S' ELSE 'D' END || substr(o_orderpriority, 1, 1) AS slot,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'singles' ELSE 'doubles' END AS discipline, o_custkey
  FROM orders),
participants AS (SELECT l_orderkey AS match_id, l_suppkey AS player_id, min(l_linestatus) AS side FROM lineitem GROUP BY 1, 2),
match_players AS (SELECT m.match_id, m.played_on, m.winner_side, m.slot, m.discipline, p.player_id, p.side FROM court_matches m JOIN participants p ON p.match_id = m.match_id),
leagues AS (SELECT m.match_id, CASE WHEN m.match_id % 23 <> 0 THEN c.c_mktsegment END AS league_context FROM court_matches m LEFT JOIN customer c ON c.c_custkey = m.o_custkey),
team_matches AS (
  SELECT m.match_id, m.played_on, c.c_nationkey AS home_team_id, CAST((c.c_nationkey + 1 + m.match_id % 24) % 25 AS INTEGER) AS visiting_team_id,
         CASE WHEN m.match_id % 19 <> 0 THEN f.a END AS home_courts_won, CASE WHEN m.match_id % 19 <> 0 THEN f.r END AS visiting_courts_won,
         {_sql_choice(TIMES, "m.match_id")} AS scheduled_time, {_sql_choice(SITES, "m.match_id")} AS site, CASE m.match_id % 7 WHEN 3 THEN 1 WHEN 5 THEN 2 END AS event_id
  FROM court_matches m JOIN customer c ON c.c_custkey = m.o_custkey
  LEFT JOIN (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r FROM lineitem GROUP BY 1) f ON f.l_orderkey = m.match_id),
ratings AS (SELECT event_id AS rating_id, user_id AS player_id, event_type AS source, value, CAST(ts AS DATE) AS observed_on FROM events),
availability AS (
  SELECT player_id, day, CASE WHEN t IN ('view', 'click') THEN 'available' WHEN t = 'purchase' THEN 'uncertain' WHEN t = 'error' THEN 'unavailable' END AS status
  FROM (SELECT user_id AS player_id, CAST(ts AS DATE) AS day, event_type AS t, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) x
  WHERE k = 1 AND t IN ('view', 'click', 'purchase', 'error')),
happenings AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS event_id, r_name AS event_name, DATE '{FIRST_DAY}' + r_regionkey * 6 AS starts_on, DATE '{FIRST_DAY}' + r_regionkey * 6 + 9 AS ends_on, CASE WHEN r_regionkey % 2 = 0 THEN 'S1:singles,S2:singles,D3:doubles,D4:doubles' END AS format FROM region),
entries AS (SELECT n_nationkey AS team_id, CAST(n_regionkey + 1 AS INTEGER) AS event_id FROM nation),
memberships AS (
  SELECT player_id, team_id, CAST(NULL AS INTEGER) AS event_id, player_id % 13 = 0 AS retired FROM players
  UNION ALL
  SELECT p.player_id, p.team_id, e.event_id, false FROM players p JOIN entries e ON e.team_id = p.team_id WHERE p.team_id < 20 AND p.player_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) <= DATE '{REGISTERED_UNTIL}'))
"""
