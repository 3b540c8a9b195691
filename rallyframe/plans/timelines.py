"""Queries as of a day, over frames and windows of time, over grouping sets, of ordered lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import timeline
from rallyframe.plans import bind
from rallyframe.plans.registry import query
from rallyframe.sources import lists
from rallyframe.sources.store import shared_folder
from rallyframe.streaming import windows


@query(f"""SELECT q.match_id, q.player_id, q.day, r.value, r.observed_on FROM (SELECT match_id, player_id, DATE '{bind.FIRST_DAY}' - 3 + CAST(match_id % 40 AS INTEGER) AS day FROM match_players) q
ASOF LEFT JOIN (SELECT player_id, observed_on, max_by(value, rating_id) AS value FROM ratings GROUP BY 1, 2) r ON q.player_id = r.player_id AND q.day >= r.observed_on""")
def rating_as_of_match(s, d):
    """Each player's rating as of the day of each of its matches (days moved into the month of the ratings; some lie before any)."""
    day = F.date_add(F.lit(bind.FIRST_DAY).cast("date"), (F.col("match_id") % 40).cast("int") - 3)
    played = bind.match_players(s, d).select("match_id", "player_id", day.alias("day"))
    return timeline.as_of(played, bind.ratings(s, d), "player_id", "day", "observed_on", ["rating_id"], ["value", "observed_on"], bucket_days=5)


@query("""SELECT player_id, day, played, won, coalesce(sum(played) OVER w, 0) AS played_before, coalesce(sum(won) OVER w, 0) AS won_before, date_diff('day', lag(day) OVER (PARTITION BY player_id ORDER BY day), day) AS rest_days
FROM (SELECT player_id, played_on AS day, count(*) AS played, count(CASE WHEN winner_side = side THEN 1 END) AS won FROM match_players WHERE played_on IS NOT NULL GROUP BY 1, 2) x
WINDOW w AS (PARTITION BY player_id ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def recent_form(s, d):
    """What each player did in the 90 days before each day of play, and how long it rested."""
    return timeline.form(bind.match_players(s, d))


@query("""SELECT team_id, discipline, slot, CAST(grouping(team_id, discipline, slot) AS INTEGER) AS level, count(*) AS matches, count(CASE WHEN winner_side = side THEN 1 END) AS wins, count(CASE WHEN winner_side <> side THEN 1 END) AS losses
FROM match_players m JOIN players p ON p.player_id = m.player_id GROUP BY GROUPING SETS ((team_id, discipline, slot), (team_id, discipline), (discipline, slot), (team_id), ())""")
def records_by_grouping(s, d):
    """Records by team, discipline and slot, by some of them and over all, in one pass."""
    rows = bind.match_players(s, d).join(bind.players(s, d).select("player_id", "team_id"), "player_id")
    columns = ["team_id", "discipline", "slot"]
    return timeline.grouped_records(rows, [columns, columns[:2], columns[1:], columns[:1], []], columns)


@query("""WITH g AS (SELECT (1 + 0.01) / (1 - 0.01) AS gamma), b AS (SELECT event_type AS source, CAST(sign(value) AS INTEGER) AS sg, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) / ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE))) AS BIGINT) END AS bucket FROM events WHERE value IS NOT NULL),
c AS (SELECT source, sg, bucket, count(*) AS n FROM b GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY sg, sg * bucket) AS upto, sum(n) OVER (PARTITION BY source) AS total FROM c),
q AS (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.9, 0.99]) AS q)
SELECT source, q, CAST(total AS BIGINT) AS n, round(sg * 2 * pow(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE), bucket) / (CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE) + 1), 6) AS value FROM u, q WHERE upto >= greatest(ceil(q * total), 1) AND upto - n < greatest(ceil(q * total), 1)""", base=False)
def rating_quantiles(s, d):
    """Quantiles of the ratings of each source within one hundredth of their value, from daily sketches that are merged."""
    r = bind.ratings(s, d)
    daily = timeline.quantile_sketch(r, ["source", "observed_on"], "value")
    found = timeline.sketch_quantiles(timeline.merge_sketches(daily, ["source"]), ["source"], [0.25, 0.5, 0.9, 0.99])
    return found.withColumn("value", F.round("value", 6))


def _events(s, d):
    return bind.read(s, d, "events").select("ts", "user_id", "event_type", "value")


def _texts(df):
    """Times as text, which all engines print alike."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in ("begins", "ends") else F.col(c) for c in df.columns])


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"SELECT {_STAMP.format('b')} AS begins, {_STAMP.format('b + INTERVAL 6 HOUR')} AS ends, event_type, n, highest FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2) x", base=False)
def event_windows(s, d):
    """Events by kind in windows of six hours."""
    return _texts(windows.tumbling(_events(s, d), "6 hours", ["event_type"]))


@query(f"""SELECT {_STAMP.format('b')} AS begins, {_STAMP.format('b + INTERVAL 7 DAY')} AS ends, event_type, count(*) AS n, max(value) AS highest
FROM (SELECT event_type, value, date_trunc('day', ts) - to_days(CAST(unnest(range(7)) AS INTEGER)) AS b FROM events) x GROUP BY b, event_type""", base=False)
def event_windows_sliding(s, d):
    """Events by kind in weeks that begin on each day."""
    return _texts(windows.sliding(_events(s, d), "7 days", "1 day", ["event_type"]))


@query(f"""SELECT {_STAMP.format('min(ts)')} AS begins, {_STAMP.format('max(ts) + INTERVAL 8 HOUR')} AS ends, user_id, count(*) AS n, max(value) AS highest FROM (
SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT ts, user_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) x) y GROUP BY user_id, k""", base=False)
def event_sessions(s, d):
    """Each user's sessions: runs of events less than eight hours apart."""
    return _texts(windows.sessions(_events(s, d), "8 hours", ["user_id"]))


def _listed(s, d):
    """Lists made of the conversations, one file for each remainder of conv_id: turns, some behind a review, an empty line or a comment."""
    c = bind.read(s, d, "conversations").where("text IS NOT NULL")
    k = F.col("conv_id") + F.col("turn")
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 2), " ")
    said = F.array(F.when(k % 5 == 0, F.concat(F.lit("# Reviewed: turn "), F.col("turn").cast("string"))).when(k % 5 == 1, "# reviewed[synthetic]: made up").when(k % 5 == 2, "# a comment").when(k % 5 == 3, ""), words)
    rows = c.select((F.col("conv_id") % 3).alias("list"), "conv_id", "turn", F.posexplode(said).alias("i", "value")).where("value IS NOT NULL")
    path = shared_folder(s, "lists")
    rows.repartition("list").sortWithinPartitions("list", "conv_id", "turn", "i").select("list", "value").write.partitionBy("list").text(path)
    found = lists.lines(s, path + "/list=*")
    return found.withColumn("file", F.regexp_extract("file", "list=([0-9]+)", 1).cast("int"))


_LISTS = r"""WITH c AS (SELECT conv_id % 3 AS file, conv_id, turn, conv_id + turn AS k, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations WHERE text IS NOT NULL),
e AS (SELECT file, k, turn, trim(array_to_string(w[1:2], ' ')) AS entry, count(*) OVER (PARTITION BY file, trim(array_to_string(w[1:2], ' '))) AS copies FROM c)
SELECT CAST(file AS INTEGER) AS file, entry, CASE k % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'synthetic' END AS review, CASE k % 5 WHEN 0 THEN 'turn ' || turn WHEN 1 THEN 'made up' END AS reason,
CASE WHEN copies > 1 THEN 'duplicate' WHEN k % 5 > 1 AND regexp_matches(entry, '\p{L}[\p{L}\p{M}''-]* \p{L}') THEN 'needs a review' WHEN k % 5 = 1 AND regexp_matches(entry, '[\p{L}\p{N}]') THEN 'not synthetic' END AS error
FROM e WHERE entry <> '' AND NOT starts_with(entry, '#')"""


@query(_LISTS, base=False)
def vocabulary_lists(s, d):
    """Entries of lists with the review that stands right before each, and what is wrong with it."""
    return lists.vocabulary(_listed(s, d))
