"""Queries of small writes, windows, repairs and printed lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.functions import grammar, keys, phrases
from rallyframe.operators import roster, scope, upkeep
from rallyframe.plans import bind, catalog
from rallyframe.plans.registry import query

# Turns of conversations stand for notes: player by conversation, every third turn about a pair.
_NOTES = """, notes AS (SELECT conv_id * 1000 + turn AS note_id, conv_id AS player_id, CASE WHEN turn % 3 = 1 THEN conv_id + turn % 4 END AS pair_id, CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE text END AS note, turn // 2 AS created_at FROM conversations),
current AS (SELECT DISTINCT team_id, player_id FROM memberships WHERE NOT retired)"""


def _notes(s, d):
    k, t = F.col("conv_id"), F.col("turn")
    return bind.read(s, d, "conversations").select((k * 1000 + t).alias("note_id"), k.alias("player_id"), F.when(t % 3 == 1, k + t % 4).alias("pair_id"), F.when(k % 11 == 0, "  ").otherwise(F.col("text")).alias("note"), F.floor(t / 2).alias("created_at"))


def _current(s, d):
    return bind.memberships(s, d).where("NOT retired").select("team_id", "player_id").distinct()


@query(f"""{_NOTES} SELECT n.note_id, n.player_id, n.pair_id, CASE WHEN trim(coalesce(n.note, '')) = '' THEN 'empty' WHEN n.pair_id = n.player_id THEN 'paired with oneself' WHEN n.player_id NOT IN (SELECT player_id FROM current) THEN 'not on the roster'
  WHEN n.pair_id IS NOT NULL AND n.pair_id NOT IN (SELECT player_id FROM current) THEN 'pair not on the roster' ELSE 'recorded' END AS outcome FROM notes n""")
def note_outcomes(s, d):
    return upkeep.note_outcomes(_notes(s, d), _current(s, d))


@query(f"""{_NOTES} SELECT team_id, kind, note_id, player_id, pair_id, CAST(row_number() OVER (PARTITION BY team_id, kind ORDER BY created_at DESC, note_id DESC) AS INTEGER) AS place FROM (SELECT c.team_id, CASE WHEN n.pair_id IS NULL THEN 'player' ELSE 'pairing' END AS kind, n.* FROM notes n JOIN current c ON c.player_id = n.player_id
  WHERE n.pair_id IS NULL OR EXISTS (SELECT 1 FROM current o WHERE o.team_id = c.team_id AND o.player_id = n.pair_id)) x""")
def visible_notes(s, d):
    return upkeep.visible_notes(_notes(s, d), _current(s, d))


_NAMED = """, named AS (SELECT p_partkey AS id, lower(trim(p_name)) || ' ' || lower(p_brand) AS key FROM part), aka AS (SELECT 'aka ' || key AS key, id FROM named WHERE id % 5 = 0), held AS (SELECT key, id FROM named UNION SELECT key, id FROM aka)"""


def _named(s, d):
    p = bind.read(s, d, "part").select(F.col("p_partkey").alias("id"), keys.ascii_name_key(F.concat(F.trim("p_name"), F.lit(" "), "p_brand")).alias("key"))
    return p, p.where("id % 5 = 0").select(F.concat(F.lit("aka "), "key").alias("key"), "id")


@query(f"""{_NAMED}, asked AS (SELECT id AS request, id, CASE id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'aka ' || key WHEN 2 THEN upper(key) WHEN 3 THEN 'new ' || id WHEN 4 THEN 'aka ' || key ELSE key || 's' END AS alias FROM named),
keyed AS (SELECT *, lower(trim(alias)) AS key FROM asked), other AS (SELECT k.request, min(h.id) AS holder FROM keyed k JOIN held h ON h.key = k.key AND h.id <> k.id GROUP BY 1)
SELECT k.request, CASE WHEN trim(k.alias) = '' THEN 'empty' WHEN o.holder IS NOT NULL THEN 'held by another' WHEN EXISTS (SELECT 1 FROM aka a WHERE a.key = k.key AND a.id = k.id) THEN 'already recorded' ELSE 'recorded' END AS outcome, o.holder FROM keyed k LEFT JOIN other o ON o.request = k.request""")
def alias_outcomes(s, d):
    named, aka = _named(s, d)
    k = F.col("id")
    alias = F.when(k % 6 == 0, " ").when((k % 6).isin(1, 4), F.concat(F.lit("aka "), "key")).when(k % 6 == 2, F.upper("key")).when(k % 6 == 3, F.concat(F.lit("new "), k.cast("string"))).otherwise(F.concat("key", F.lit("s")))
    return upkeep.alias_outcomes(named.select(k.alias("request"), "id", alias.alias("alias")), named, aka)


@query(f"""{_NAMED}, asked AS (SELECT id AS request, CASE id % 5 WHEN 0 THEN key WHEN 1 THEN key || 'x' WHEN 2 THEN 'quite another ' || id WHEN 3 THEN key || 'y' ELSE 'brand new one ' || id END AS name,
  CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN CASE id % 5 WHEN 0 THEN key WHEN 1 THEN key || 'x' WHEN 2 THEN 'quite another ' || id WHEN 3 THEN key || 'y' ELSE 'brand new one ' || id END WHEN 2 THEN 'far away' WHEN 3 THEN ' ' ELSE CASE id % 5 WHEN 0 THEN key WHEN 1 THEN key || 'x' WHEN 2 THEN 'quite another ' || id WHEN 3 THEN key || 'y' ELSE 'brand new one ' || id END || 'z' END AS near_name FROM named),
n AS (SELECT key, count(DISTINCT id) AS n FROM held GROUP BY 1), uniq AS (SELECT DISTINCT key FROM named), near AS (SELECT DISTINCT a.name AS key FROM (SELECT DISTINCT name FROM asked) a JOIN uniq b ON abs(length(a.name) - length(b.key)) <= 2 AND levenshtein(a.name, b.key) BETWEEN 1 AND 2),
told AS (SELECT a.*, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m, r.key IS NOT NULL AS near FROM asked a LEFT JOIN n x ON x.key = trim(a.name) LEFT JOIN n y ON y.key = trim(a.near_name) LEFT JOIN near r ON r.key = a.name),
said AS (SELECT request, near_name, m, CASE WHEN trim(near_name) = '' THEN 'empty' WHEN trim(near_name) = trim(name) THEN 'same name' WHEN near_name IS NOT NULL AND NOT levenshtein(name, near_name) BETWEEN 1 AND 2 THEN 'not near' WHEN n > 1 OR near_name IS NOT NULL AND m > 1 THEN 'already ambiguous'
  WHEN n = 1 AND (near_name IS NULL OR m = 1) THEN 'already on file' WHEN near_name IS NULL AND NOT near THEN 'not ambiguous' WHEN n = 1 THEN 'already on file' ELSE 'created' END AS outcome FROM told)
SELECT request, outcome, outcome NOT IN ('empty', 'same name', 'not near', 'already ambiguous', 'not ambiguous') AND near_name IS NOT NULL AND m = 0 AS pair_created FROM said""")
def distinct_outcomes(s, d):
    named, aka = _named(s, d)
    k = F.col("id")
    name = F.when(k % 5 == 0, F.col("key")).when(k % 5 == 1, F.concat("key", F.lit("x"))).when(k % 5 == 2, F.concat(F.lit("quite another "), k.cast("string"))).when(k % 5 == 3, F.concat("key", F.lit("y"))).otherwise(F.concat(F.lit("brand new one "), k.cast("string")))
    near = F.when(k % 7 == 0, None).when(k % 7 == 1, name).when(k % 7 == 2, "far away").when(k % 7 == 3, " ").otherwise(F.concat(name, F.lit("z")))
    return upkeep.distinct_outcomes(named.select(k.alias("request"), name.alias("name"), near.alias("near_name")), named.union(aka.select("id", "key")), named.select("key"))


@query("""SELECT n_regionkey AS scope, n_nationkey AS team_id, CASE WHEN n_regionkey = 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN true END WHEN n_regionkey = 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN true END WHEN n_nationkey = w THEN true END AS is_home
FROM nation JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS w FROM nation GROUP BY 1) x ON x.r = n_regionkey""", base=False)
def home_teams(s, d):
    """Regions as scopes; one asks for nothing, one for a team it does not have."""
    n = bind.read(s, d, "nation").select(F.col("n_regionkey").alias("scope"), F.col("n_nationkey").alias("team_id"), F.when(F.col("n_nationkey") % 2 == 0, True).alias("is_home"))
    asked = n.groupBy("scope").agg(F.min("team_id").alias("team_id")).where("scope <> 4").select("scope", F.when(F.col("scope") == 3, 999).otherwise(F.col("team_id")).alias("team_id"))
    return upkeep.designated(n, asked)


@query("""SELECT rating_id, player_id, source, value, CASE WHEN source IN ('view', 'click') AND observed_on = DATE '2024-01-20' THEN DATE '2024-01-19' ELSE observed_on END AS observed_on FROM ratings r
WHERE NOT (source IN ('view', 'click') AND observed_on = DATE '2024-01-20' AND EXISTS (SELECT 1 FROM ratings e WHERE e.player_id = r.player_id AND e.source = r.source AND e.observed_on = DATE '2024-01-19'))""")
def redated_ratings(s, d):
    day = lambda t: F.lit(t).cast("date")
    return upkeep.redated(bind.ratings(s, d), ["player_id", "source"], day("2024-01-20"), day("2024-01-19"), F.col("source").isin("view", "click"))


@query("SELECT s_suppkey AS player_id, lower(s_name) AS name_key FROM supplier", base=False)
def rekeyed_players(s, d):
    stale = bind.read(s, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.lit("stale").alias("name_key"))
    return upkeep.rekeyed(stale).select("player_id", "name_key")


@query("""SELECT m.match_id, CASE WHEN m.match_id % 5 <> 0 THEN 's' || m.match_id END AS source_match_id, t.match_id AS team_match_id FROM court_matches m LEFT JOIN team_matches t ON m.match_id % 5 <> 0 AND t.match_id % 3 = 0 AND t.match_id = m.match_id""")
def court_parents(s, d):
    k = F.col("match_id")
    source = F.when(k % 5 != 0, F.concat(F.lit("s"), k.cast("string")))
    matches = bind.team_matches(s, d).where(k % 3 == 0).select(F.concat(F.lit("s"), k.cast("string")).alias("source_match_id"), k.alias("team_match_id"))
    return upkeep.with_parent(bind.court_matches(s, d).select("match_id", source.alias("source_match_id")), matches)


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'event' ELSE 'today' END AS anchored_to, anchor, CAST(anchor - INTERVAL 1 YEAR AS DATE) AS since, '12mo to ' || strftime(anchor, '%Y-%m-%d') AS label FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN starts_on ELSE DATE '2024-02-29' END AS anchor FROM happenings) x""")
def evidence_windows(s, d):
    e = bind.events(s, d).withColumn("starts_on", F.when(F.col("event_id") % 2 == 0, F.col("starts_on")))
    return upkeep.windows(e, F.lit("2024-02-29").cast("date"))


@query("""SELECT match_id, played_on AS anchor FROM court_matches WHERE played_on IS NULL OR match_id % 6 IN (1, 2)""")
def unverified_windows(s, d):
    """Claimed windows of which a sixth have a bound, and a sixth a label, that does not follow from the anchor."""
    k, anchor = F.col("match_id"), F.col("played_on")
    since = F.when(k % 6 == 1, F.date_sub(anchor, 364 * 2)).otherwise(F.add_months(anchor, -12))
    label = F.concat(F.lit("12mo to "), F.date_format(F.when(k % 6 == 2, F.date_add(anchor, 1)).otherwise(anchor), "yyyy-MM-dd"))
    return upkeep.unverified_windows(bind.court_matches(s, d).select("match_id", anchor.alias("anchor"), since.alias("since"), label.alias("label"))).select("match_id", "anchor")


@query("""SELECT m.player_id, n.n_name || CASE WHEN max(m.event_id) IS NULL THEN CASE WHEN bool_or(m.retired) THEN ' (former)' ELSE '' END ELSE ' (season roster' || CASE WHEN bool_or(m.event_id IS NULL AND m.retired) THEN ' — former' ELSE '' END || '; registered for "' || max(h.event_name) || '")' END AS line
FROM memberships m JOIN nation n ON n.n_nationkey = m.team_id LEFT JOIN happenings h ON h.event_id = m.event_id GROUP BY m.player_id, n.n_name""")
def membership_lines(s, d):
    m = bind.memberships(s, d).join(bind.events(s, d).select("event_id", "event_name"), "event_id", "left").join(bind.teams(s, d), "team_id")
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_name", "retired"))).alias("rows")
    return m.groupBy("player_id", "team_name").agg(rows).select("player_id", phrases.membership_text(phrases.shown(F.col("team_name"), F.lit("team")), F.col("rows")).alias("line"))


@query("""SELECT player_id, string_agg(source || ' ' || v, ', ' ORDER BY source) AS line FROM (SELECT player_id, CASE source WHEN 'view' THEN 'NTRP' WHEN 'click' THEN 'WTN-S' ELSE source END AS source, CASE source WHEN 'view' THEN printf('%.1f', CASE WHEN value * 4 = floor(value * 4) THEN value + 0.001 ELSE value END) || 'C' ELSE printf('%.2f', value) END AS v
FROM (SELECT *, row_number() OVER (PARTITION BY player_id, source ORDER BY observed_on DESC, rating_id DESC) AS k FROM ratings) x WHERE k = 1) y GROUP BY 1""")
def rating_lines(s, d):
    from rallyframe.operators import ratings

    last = ratings.latest(bind.ratings(s, d))
    source = F.when(F.col("source") == "view", "ntrp").when(F.col("source") == "click", "wtn_singles").otherwise(F.col("source"))
    e = last.select("player_id", F.struct(phrases.source_label(source).alias("shown"), source.alias("source"), "value", F.when(F.col("source") == "view", "C").alias("rating_type")).alias("e"))
    return e.groupBy("player_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("player_id", phrases.ratings_line(F.col("e")).alias("line"))


@query(f"""SELECT p.player_id, CASE WHEN p.player_id % 4 = 0 THEN 'no league scope applied (event "Cup") — every league counts, ' || count(CASE WHEN {catalog._RETAIN} THEN 1 END) || CASE WHEN count(CASE WHEN {catalog._RETAIN} THEN 1 END) = 1 THEN ' court match' ELSE ' court matches' END
  ELSE 'excluding league contexts starting with "MA" or "BUILD"' || CASE WHEN p.player_id % 2 = 0 THEN ' (event "Cup")' ELSE '' END || ' — ' || count(CASE WHEN {catalog._RETAIN} THEN 1 END) || ' of ' || count(*) || CASE WHEN count(*) = 1 THEN ' court match' ELSE ' court matches' END || ' retained, ' || count(CASE WHEN NOT {catalog._RETAIN} THEN 1 END) || ' excluded' END AS line
FROM participants p JOIN leagues l ON l.match_id = p.match_id GROUP BY 1""")
def scope_lines(s, d):
    mode, prefixes = scope.parse_scope(catalog.SCOPE)
    told = scope.scope_summary(bind.participants(s, d).join(bind.leagues(s, d), "match_id"), mode, prefixes, fold=F.lower)
    k = F.col("player_id")
    label = grammar.league_scope_label(F.lit(mode), F.array(*map(F.lit, prefixes)))
    return told.select("player_id", phrases.scope_line(F.when(k % 4 != 0, mode), label, F.when(k % 2 == 0, "Cup"), F.col("considered"), F.col("retained"), F.col("excluded")).alias("line"))


@query(f"""{catalog._ROSTER}, n AS (SELECT e.team_id, e.event_id, (SELECT count(*) FROM registered r WHERE r.team_id = e.team_id AND r.event_id = e.event_id) AS named, (SELECT count(*) FROM season s WHERE s.team_id = e.team_id) AS season FROM entries e)
SELECT n.team_id, CASE WHEN named > 0 THEN 'registered ' || named || ' for event "' || h.event_name || '" (season roster: ' || season || ')' ELSE 'season roster (event "' || h.event_name || '") — no registered members' END AS line FROM n JOIN happenings h ON h.event_id = n.event_id""")
def roster_lines(s, d):
    m, e = bind.memberships(s, d).where("NOT retired"), bind.entries(s, d)
    named = m.where("event_id IS NOT NULL").groupBy("team_id", "event_id").agg(F.count_distinct("player_id").alias("named"))
    season = m.where("event_id IS NULL").groupBy("team_id").agg(F.count_distinct("player_id").alias("season"))
    t = e.join(named, ["team_id", "event_id"], "left").join(season, "team_id", "left").join(bind.events(s, d), "event_id").fillna(0, ["named", "season"])
    return t.select("team_id", phrases.roster_line(F.when(F.col("named") > 0, "registered").otherwise("season"), F.col("event_name"), F.col("named"), F.col("season")).alias("line"))


@query("""SELECT m.player_id, n.n_name AS team_name, m.event_id, CAST(row_number() OVER (PARTITION BY m.player_id ORDER BY n.n_name, m.event_id NULLS FIRST) AS INTEGER) AS place FROM memberships m JOIN nation n ON n.n_nationkey = m.team_id""")
def membership_order(s, d):
    from pyspark.sql import Window

    m = bind.memberships(s, d).join(bind.teams(s, d), "team_id")
    return m.select("player_id", "team_name", "event_id", F.row_number().over(Window.partitionBy("player_id").orderBy("team_name", F.asc_nulls_first("event_id"))).alias("place"))


@query("""SELECT a.player_id, b.player_id AS partner_id, coalesce(CASE WHEN b.player_id % 6 <> 0 THEN p.name END, 'player #' || b.player_id) AS partner, count(*) AS matches FROM match_players a JOIN match_players b ON a.match_id = b.match_id AND a.side = b.side AND a.player_id <> b.player_id LEFT JOIN players p ON p.player_id = b.player_id
WHERE a.discipline = 'doubles' GROUP BY 1, 2, 3""")
def partner_names(s, d):
    """Partners by name; those of whom no name is on file by number."""
    from rallyframe.operators import records

    known = bind.players(s, d).where("player_id % 6 <> 0").select(F.col("player_id").alias("partner_id"), "name")
    f = records.partner_frequency(bind.match_players(s, d)).join(known, "partner_id", "left")
    return f.select("player_id", "partner_id", F.coalesce("name", F.concat(F.lit("player #"), F.col("partner_id").cast("string"))).alias("partner"), "matches")


@query("""SELECT o_orderkey, regexp_matches(t, '^[1-9][0-9]{3}$') AS valid FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '0' || (o_orderkey % 1000) WHEN 1 THEN CAST(1000 + o_orderkey % 9000 AS VARCHAR) WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN ' 2024' ELSE '2024x' END AS t FROM orders) x""", base=False)
def season_texts(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("0"), (k % 1000).cast("string"))).when(k % 5 == 1, (1000 + k % 9000).cast("string")).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, " 2024").otherwise("2024x")
    return bind.read(s, d, "orders").select("o_orderkey", keys.is_season(text).alias("valid"))


@query("SELECT team_id, player_id, event_id FROM memberships WHERE NOT retired AND event_id IS NULL AND player_id NOT IN (SELECT player_id FROM memberships WHERE NOT retired AND event_id IS NOT NULL)")
def season_only_members(s, d):
    return roster.season_only(bind.memberships(s, d))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' Jr' WHEN 1 THEN '100%' WHEN 2 THEN '' END AS name, '/h.aspx?year=2026&playername=' || replace(c_name, '#', '%23') || '+%26+Co&mt=0&lt=0&yr=0' AS link,
  CASE WHEN c_custkey % 5 = 0 THEN 'page' ELSE lower(substr(regexp_replace(replace(c_name, '#', '-') || '-x-' || repeat('long-', c_custkey % 40), '-+$', ''), 1, 120)) END AS slug FROM customer""",
    base=False,
)
def link_texts(s, d):
    """Encoded, broken, empty and missing parameters; links and file names made of names."""
    k = F.col("c_custkey")
    href = F.when(k % 4 == 0, F.concat(F.lit("/p.aspx?a=1&amp;name="), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("+Jr&b=2"))).when(k % 4 == 1, "/p.aspx?name=100%").when(k % 4 == 2, "?name=&b=2").otherwise("/p.aspx?other=1#name=x")
    url = F.when(k % 5 == 0, "https://--/").otherwise(F.concat(F.lit("https://"), "c_name", F.lit("/?x="), F.repeat(F.lit("long&"), (k % 40).cast("int")), F.lit("!")))
    return bind.read(s, d, "customer").select("c_custkey", grammar.href_param(href, "name").alias("name"), grammar.history_link(F.lit("/h.aspx"), F.lit("2026"), F.concat("c_name", F.lit(" & Co"))).alias("link"), grammar.url_slug(url).alias("slug"))
