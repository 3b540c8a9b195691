"""Queries of dossiers, folder names and the field's index, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import records, roster, scope
from rallyframe.plans import bind, catalog, dossier
from rallyframe.plans.registry import query

_PARTS = f"""{catalog._ROSTER}, r AS (SELECT team_id, count(CASE WHEN played_on >= {catalog._SINCE} AND ours > theirs THEN 1 END) AS wins, count(CASE WHEN played_on >= {catalog._SINCE} AND ours < theirs THEN 1 END) AS losses
FROM (SELECT home_team_id AS team_id, played_on, home_courts_won AS ours, visiting_courts_won AS theirs FROM team_matches
      UNION ALL SELECT visiting_team_id, played_on, visiting_courts_won, home_courts_won FROM team_matches) x GROUP BY 1),
p AS (SELECT player_id, count(CASE WHEN played_on >= {catalog._SINCE} AND winner_side = side THEN 1 END) AS wins, count(CASE WHEN played_on >= {catalog._SINCE} AND winner_side <> side THEN 1 END) AS losses,
  count(CASE WHEN played_on >= {catalog._SINCE} AND winner_side IS NULL THEN 1 END) AS undecided FROM match_players GROUP BY 1),
slots AS (SELECT q.team_id, m.slot, count(*) AS n FROM match_players m JOIN players q ON q.player_id = m.player_id GROUP BY 1, 2),
s1 AS (SELECT team_id, string_agg(scope || ': ' || n, chr(10) ORDER BY scope) AS text FROM (SELECT team_id, scope, count(*) AS n FROM resolved GROUP BY 1, 2) x GROUP BY 1),
s2 AS (SELECT e.team_id, string_agg(q.name, chr(10) ORDER BY lower(q.name), q.player_id) AS text FROM entries e JOIN season s ON s.team_id = e.team_id JOIN players q ON q.player_id = s.player_id LEFT JOIN registered g ON g.team_id = e.team_id AND g.event_id = e.event_id AND g.player_id = s.player_id
  WHERE g.player_id IS NULL AND (e.team_id, e.event_id) IN (SELECT team_id, event_id FROM registered) GROUP BY 1),
s3 AS (SELECT q.team_id, count(CASE WHEN {catalog._RETAIN} THEN 1 END) || ' of ' || count(*) || ' retained' AS text FROM participants m JOIN players q ON q.player_id = m.player_id JOIN leagues l ON l.match_id = m.match_id GROUP BY 1),
s4 AS (SELECT team_id, string_agg(slot || ' ×' || n, chr(10) ORDER BY n DESC, slot) AS text FROM slots GROUP BY 1)"""

TITLES = ("Roster", "Not registered", "Evidence scope", "Slots")


def _parts(s, d):
    names = bind.players(s, d)
    members = roster.resolve_rosters(bind.memberships(s, d), bind.entries(s, d))
    sizes = members.groupBy("team_id", "scope").agg(F.count("*").alias("n"))
    absent = roster.absent(bind.memberships(s, d), bind.entries(s, d)).join(names.select("player_id", "name"), "player_id").withColumn("k", F.lower("name"))
    told = scope.scope_summary(bind.participants(s, d).join(names.select("player_id", "team_id"), "player_id").join(bind.leagues(s, d), "match_id"), *scope.parse_scope(catalog.SCOPE), by="team_id", fold=F.lower)
    slots = records.slot_tendencies(bind.match_players(s, d).join(names, "player_id"), "team_id").withColumn("k", -F.col("matches"))
    sections = (
        dossier.list_section(sizes, ["scope"], F.concat("scope", F.lit(": "), F.col("n").cast("string"))), dossier.list_section(absent, ["k", "player_id"], F.col("name")),
        told.select("team_id", F.concat(F.col("retained").cast("string"), F.lit(" of "), F.col("considered").cast("string"), F.lit(" retained")).alias("text")), dossier.list_section(slots, ["k", "slot"], F.concat("slot", F.lit(" ×"), F.col("matches").cast("string"))),
    )
    record = records.team_record(bind.team_matches(s, d), catalog._since()).select("team_id", "wins", "losses")
    return bind.teams(s, d), record, names, records.windowed_record(bind.match_players(s, d), catalog._since()), dict(zip(TITLES, sections))


_SLUG = "trim(regexp_replace(lower(n.n_name), '[^a-z0-9]+', '-', 'g'))"


@query(f"""{_PARTS},
l AS (SELECT q.team_id, string_agg('| ' || q.name || ' | ' || coalesce(p.wins, 0) || '-' || coalesce(p.losses, 0) || ' | ' || coalesce(p.undecided, 0) || ' |', chr(10) ORDER BY lower(q.name), q.player_id) AS lines FROM players q LEFT JOIN p ON p.player_id = q.player_id GROUP BY 1)
SELECT n.n_nationkey AS team_id, md5('# ' || n.n_name || chr(10) || chr(10) || 'Record: ' || coalesce(r.wins, 0) || '-' || coalesce(r.losses, 0) || chr(10) || chr(10) || '| Player | Record | Undecided |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || coalesce(l.lines, 'no players recorded') || {" || ".join(f"chr(10) || chr(10) || '## {t}' || chr(10) || chr(10) || coalesce(s{k + 1}.text, '_None recorded._')" for k, t in enumerate(TITLES))} || chr(10)) AS digest, {_SLUG} AS directory
FROM nation n LEFT JOIN r ON r.team_id = n.n_nationkey LEFT JOIN l ON l.team_id = n.n_nationkey {" ".join(f"LEFT JOIN s{k} ON s{k}.team_id = n.n_nationkey" for k in range(1, 5))}""")
def team_dossiers(s, d):
    text = dossier.markdown(*_parts(s, d))
    return text.join(dossier.directory_names(bind.teams(s, d)), "team_id").select("team_id", F.md5("text").alias("digest"), "directory")


@query(f"""{_PARTS},
l AS (SELECT q.team_id, string_agg('<tr><td>' || q.name || '</td><td>' || coalesce(p.wins, 0) || '-' || coalesce(p.losses, 0) || '</td><td>' || coalesce(p.undecided, 0) || '</td></tr>', chr(10) ORDER BY lower(q.name), q.player_id) AS lines FROM players q LEFT JOIN p ON p.player_id = q.player_id GROUP BY 1)
SELECT n.n_nationkey AS team_id, md5('<!doctype html>' || chr(10) || '<meta charset=''utf-8''>' || chr(10) || '<title>' || n.n_name || '</title>' || chr(10) || '<h1>' || n.n_name || '</h1>' || chr(10)
  || '<p>Record: ' || coalesce(r.wins, 0) || '-' || coalesce(r.losses, 0) || '</p>' || chr(10) || '<table>' || chr(10) || '<tr><th>Player</th><th>Record</th><th>Undecided</th></tr>' || chr(10)
  || coalesce(l.lines, '<tr><td colspan=''3''>no players recorded</td></tr>') || chr(10) || '</table>' || chr(10) || {" || ".join(f"'<h2>{t}</h2>' || chr(10) || '<pre>' || coalesce(s{k + 1}.text, 'None recorded.') || '</pre>' || chr(10)" for k, t in enumerate(TITLES))}) AS digest
FROM nation n LEFT JOIN r ON r.team_id = n.n_nationkey LEFT JOIN l ON l.team_id = n.n_nationkey {" ".join(f"LEFT JOIN s{k} ON s{k}.team_id = n.n_nationkey" for k in range(1, 5))}""")
def team_dossier_pages(s, d):
    return dossier.html(*_parts(s, d)).select("team_id", F.md5("text").alias("digest"))


@query(f"""{_PARTS}, field AS (SELECT DISTINCT team_id, event_id FROM memberships WHERE event_id IS NOT NULL UNION SELECT team_id, event_id FROM entries WHERE event_id NOT IN (SELECT event_id FROM memberships WHERE event_id IS NOT NULL))
SELECT f.event_id, md5('# Field' || chr(10) || chr(10) || string_agg('- [' || n.n_name || '](' || {_SLUG} || '/dossier.md) ' || coalesce(r.wins, 0) || '-' || coalesce(r.losses, 0), chr(10) ORDER BY lower(n.n_name), f.team_id) || chr(10)) AS digest
FROM field f JOIN nation n ON n.n_nationkey = f.team_id LEFT JOIN r ON r.team_id = f.team_id GROUP BY 1""")
def field_index(s, d):
    field = roster.registered_teams(bind.memberships(s, d), bind.entries(s, d))
    record = records.team_record(bind.team_matches(s, d), catalog._since()).select("team_id", "wins", "losses")
    return dossier.index(field, bind.teams(s, d), dossier.directory_names(bind.teams(s, d)), record).select("event_id", F.md5("text").alias("digest"))


@query("""SELECT c_custkey AS team_id, 'customer-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || CASE WHEN c_custkey < 97 OR c_custkey = 97 AND false THEN '' ELSE '-' || c_custkey END AS directory FROM (SELECT c_custkey FROM customer) x""", base=False)
def directory_names(s, d):
    """Names that many teams share but for their punctuation: the first keeps the slug, each other one has its id behind it."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Customer #"), F.lpad((k % 97).cast("string"), 2, "0"), F.when(k % 2 == 0, "!").otherwise(" ?"))
    return dossier.directory_names(bind.read(s, d, "customer").select(k.alias("team_id"), name.alias("team_name")))


_FACTS = f""", w AS (SELECT player_id, discipline, count(CASE WHEN winner_side = side THEN 1 END) AS w, count(CASE WHEN winner_side <> side THEN 1 END) AS l, count(CASE WHEN winner_side IS NULL THEN 1 END) AS u FROM match_players WHERE played_on >= {catalog._SINCE} GROUP BY 1, 2),
said AS (SELECT player_id, discipline, w || '-' || l || CASE WHEN u > 0 THEN ' (' || u || ' undecided)' ELSE '' END AS t FROM w),
sl AS (SELECT player_id, string_agg(slot || '×' || n, ', ' ORDER BY n DESC, slot) AS t FROM (SELECT player_id, slot, count(*) AS n FROM match_players WHERE played_on >= {catalog._SINCE} GROUP BY 1, 2) x GROUP BY 1),
d AS (SELECT match_id, side, player_id FROM match_players WHERE discipline = 'doubles' AND played_on >= {catalog._SINCE}),
pa AS (SELECT x.player_id, string_agg(q.name || ' ×' || n, ', ' ORDER BY n DESC, x.partner) AS t FROM (SELECT a.player_id, b.player_id AS partner, count(*) AS n FROM d a JOIN d b ON a.match_id = b.match_id AND a.side = b.side AND a.player_id <> b.player_id GROUP BY 1, 2) x JOIN players q ON q.player_id = x.partner GROUP BY 1),
facts AS (SELECT p.player_id, p.name, coalesce(s.t, '0-0') AS singles, coalesce(b.t, '0-0') AS doubles, coalesce(l.t, 'none') AS slots, coalesce(a.t, 'none') AS partners FROM players p LEFT JOIN said s ON s.player_id = p.player_id AND s.discipline = 'singles'
  LEFT JOIN said b ON b.player_id = p.player_id AND b.discipline = 'doubles' LEFT JOIN sl l ON l.player_id = p.player_id LEFT JOIN pa a ON a.player_id = p.player_id)"""


def _facts(s, d):
    rows = records.rows_within(bind.match_players(s, d), catalog._since())
    return dossier.player_facts(bind.players(s, d), records.windowed_record(rows), records.slot_tendencies(rows), records.partner_frequency(rows))


@query(f"""{_FACTS} SELECT player_id, '### ' || name || chr(10) || chr(10) || '**Record (12 months):** singles ' || singles || ', doubles ' || doubles || chr(10) || chr(10) || '**Court-slot tendencies:** ' || slots || chr(10) || chr(10) || '**Partner frequency:** ' || partners AS text FROM facts""")
def player_write_ups(s, d):
    """Each player's write-up in Markdown, over the window."""
    return dossier.player_blocks(_facts(s, d), "12 months")


@query(f"""{_FACTS} SELECT player_id, '<article>' || chr(10) || '<h3>' || name || '</h3>' || chr(10) || '<p>Record (12 months): singles ' || singles || ', doubles ' || doubles || '</p>' || chr(10) || '<p>Court slots: ' || slots || '</p>' || chr(10) || '<p>Partners: ' || partners || '</p>' || chr(10) || '</article>' AS text FROM facts""")
def player_write_up_pages(s, d):
    """The same as parts of a page."""
    return dossier.player_articles(_facts(s, d), "12 months")
