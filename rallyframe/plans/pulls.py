"""Queries of what is written as a whole: scorecards, pulls of teams and players, saved profiles, with their SQL.

A state and what comes in are bound to the test tables and committed to a store in the shared folder; each query
reads one table of the new state. Queries of one application share a store, as readers of one state do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import cards as card_ops
from rallyframe.operators import pull
from rallyframe.plans import bind
from rallyframe.plans.merges import _FIXTURES
from rallyframe.plans.registry import query
from rallyframe.sources.store import Store, shared_folder

_SLOTS = ("S1", "S2", "D3", "D4", "D5")


def _card_parts(s, d):
    """State of the odd matches; the first even match of each day and pair of teams is a card of two courts."""
    m, k = bind.team_matches(s, d), F.col("match_id")
    odd, even = m.where("match_id % 2 = 1"), m.where("match_id % 2 = 0 AND played_on IS NOT NULL")
    low, high = F.least("home_team_id", "visiting_team_id"), F.greatest("home_team_id", "visiting_team_id")
    first = even.groupBy("played_on", low.alias("low"), high.alias("high")).agg(F.min("match_id").alias("match_id")).select("match_id")
    even = even.join(first, "match_id")
    seats = bind.match_players(s, d)
    courts = bind.court_matches(s, d)
    slot = lambda x: F.get(F.array(*map(F.lit, _SLOTS)), x % 5)
    state = {
        "team_matches": odd,
        "courts": courts.where("match_id % 2 = 1").select("match_id", "slot", "discipline", "winner_side", F.lit(None).cast("string").alias("score"), "played_on"),
        "court_players": seats.where("match_id % 2 = 1").select("match_id", "slot", "player_id", "side"),
    }
    cards = even.select(
        k.alias("card"), k.alias("new_id"), "played_on", "scheduled_time", "site", "home_team_id", "visiting_team_id",
        F.when(k % 6 == 4, "AFRICA").when(k % 18 == 2, "No such event").alias("event_name"), (k % 31 == 0).alias("slot_twice"), (k % 37 != 0).alias("teams_known"),
    )
    on = even.select(k.alias("card"))
    played = courts.withColumnRenamed("match_id", "card").join(on, "card")
    score = F.concat(F.lit("6-"), (F.col("card") % 5).cast("string"))
    card_courts = played.select("card", "slot", "discipline", "winner_side", score.alias("score")).union(played.select("card", F.concat(F.lit("X"), slot(F.col("card"))), F.lit("singles"), F.lit(None).cast("string"), score))
    sat = seats.withColumnRenamed("match_id", "card").join(on, "card")
    sat = sat.select("card", "slot", "player_id", "side", (F.col("card") % 41 != 0).alias("on_roster"))
    return state, cards, card_courts, sat, bind.events(s, d).select("event_name", "event_id")


_made: dict[tuple[str, str, str], str] = {}


def _once(s, d, name, make):
    """The store that ``make`` filled for these tables; within an application it is made once, and again if its folder is gone."""
    key = (s.sparkContext.applicationId, d, name)
    if key in _made and Store(s, _made[key]).version():
        return Store(s, _made[key])
    store = Store(s, shared_folder(s, name))
    make(store)
    _made[key] = store.path
    return store


def _cards_written(s, d):
    def make(store):
        state, cards, courts, seats, events = _card_parts(s, d)
        store.commit(state)
        store.commit({"outcomes": card_ops.ingest_cards(store, cards, courts, seats, events)})

    return _once(s, d, "cards", make)


_CARDS = f"""{_FIXTURES}, even AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY played_on, low, high ORDER BY match_id) AS k FROM keyed WHERE match_id % 2 = 0 AND played_on IS NOT NULL) x WHERE k = 1),
odd AS (SELECT * FROM keyed WHERE match_id % 2 = 1),
tiers AS (SELECT a.match_id AS card, b.match_id AS m, a.tk = b.tk AND a.sk = b.sk AS e, (a.scheduled_time IS NULL OR b.scheduled_time IS NULL OR a.tk = b.tk) AND (a.site IS NULL OR b.site IS NULL OR a.sk = b.sk) AS l
  FROM even a JOIN odd b ON a.played_on = b.played_on AND a.low = b.low AND a.high = b.high),
par AS (SELECT card, CASE WHEN sum(CAST(e AS INT)) > 0 THEN sum(CAST(e AS INT)) ELSE sum(CAST(l AS INT)) END AS n, CASE WHEN sum(CAST(e AS INT)) > 0 THEN min(CASE WHEN e THEN m END) ELSE min(CASE WHEN l THEN m END) END AS m FROM tiers GROUP BY 1),
named AS (SELECT e.match_id AS card, e.*, CASE WHEN p.n = 1 THEN p.m END AS parent, p.n, CASE WHEN e.match_id % 6 = 4 THEN (SELECT event_id FROM happenings WHERE event_name = 'AFRICA') END AS told,
  EXISTS (SELECT 1 FROM participants q WHERE q.match_id = e.match_id) AS seated FROM even e LEFT JOIN par p ON p.card = e.match_id),
outcomes AS (SELECT n.card, CASE WHEN n.card % 31 = 0 THEN 'duplicate-slots' WHEN n.card % 37 = 0 THEN 'unknown-team' WHEN n.home_team_id = n.visiting_team_id THEN 'same-team' WHEN n.card % 18 = 2 AND n.card % 6 <> 4 THEN 'unknown-event'
  WHEN n.card % 41 = 0 AND n.seated THEN 'unresolved-players' WHEN n.n > 1 THEN 'ambiguous-parent-match' WHEN t.event_id <> n.told THEN 'conflicting-parent-event' ELSE 'accepted' END AS outcome FROM named n LEFT JOIN team_matches t ON t.match_id = n.parent),
taken AS (SELECT n.*, coalesce(n.parent, n.card) AS target FROM named n JOIN outcomes o ON o.card = n.card WHERE o.outcome = 'accepted'),
card_courts AS (SELECT t.target AS match_id, t.card, c.slot, c.discipline, c.winner_side, '6-' || (t.card % 5) AS score, t.played_on FROM taken t JOIN court_matches c ON c.match_id = t.card
  UNION ALL SELECT target, card, 'X' || list_extract(['S1', 'S2', 'D3', 'D4', 'D5'], CAST(card % 5 AS INT) + 1), 'singles', NULL, '6-' || (card % 5), played_on FROM taken)"""


@query(f"{_CARDS} SELECT o.card, o.outcome, t.target AS match_id FROM outcomes o LEFT JOIN taken t ON t.card = o.card")
def card_ingest_outcomes(s, d):
    """What became of each card, and the team match it was written to."""
    return _cards_written(s, d).read("outcomes").select("card", "outcome", "match_id")


@query(f"""{_CARDS} SELECT k.match_id, coalesce(k.event_id, t.told) AS event_id, k.home_team_id, k.visiting_team_id, k.played_on, coalesce(k.scheduled_time, t.scheduled_time) AS scheduled_time, coalesce(k.site, t.site) AS site, k.home_courts_won
FROM odd k LEFT JOIN taken t ON t.parent = k.match_id UNION ALL SELECT card, told, home_team_id, visiting_team_id, played_on, scheduled_time, site, NULL FROM taken WHERE parent IS NULL""")
def card_ingest_matches(s, d):
    """The team matches after all cards are written: found ones keep what they have and get what they lack."""
    return _cards_written(s, d).read("team_matches").select("match_id", "event_id", "home_team_id", "visiting_team_id", "played_on", "scheduled_time", "site", "home_courts_won")


@query(f"""{_CARDS} SELECT c.match_id, c.slot, c.discipline, c.winner_side, CAST(NULL AS VARCHAR) AS score, c.played_on FROM court_matches c WHERE c.match_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM card_courts x WHERE x.match_id = c.match_id AND x.slot = c.slot)
UNION ALL SELECT match_id, slot, discipline, winner_side, score, played_on FROM card_courts""")
def card_ingest_courts(s, d):
    """The courts after all cards are written: named ones are replaced, others stay."""
    return _cards_written(s, d).read("courts")


@query(f"""{_CARDS} SELECT m.match_id, m.slot, m.player_id, m.side FROM match_players m WHERE m.match_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM card_courts x WHERE x.match_id = m.match_id AND x.slot = m.slot)
UNION ALL SELECT t.target, m.slot, m.player_id, m.side FROM taken t JOIN match_players m ON m.match_id = t.card""")
def card_ingest_players(s, d):
    """Who stands on the courts after all cards are written: a replaced court has the card's players only."""
    return _cards_written(s, d).read("court_players")


def _pulled(s, d):
    return _once(s, d, "pulls", lambda store: _pull_all(s, d, store))


def _pull_all(s, d, store):
    """State: season and event members, the odd matches by source id; each team is pulled once, with faults by number."""
    t, k = F.col("team_id"), F.col("match_id")
    day = lambda x: F.date_add(F.lit(bind.FIRST_DAY).cast("date"), x.cast("int"))
    m = bind.team_matches(s, d)
    source = lambda n: F.concat(F.lit("m"), F.floor(k / n).cast("string"))
    fresh = ["event_id", "home_team_id", "visiting_team_id", "played_on", "home_courts_won", "visiting_courts_won"]
    teams = bind.teams(s, d).select("team_id", "team_name", F.when(t % 6 != 0, day(t % 5)).alias("roster_observed_at"), F.when(t % 6 != 0, F.concat(F.lit("u"), t.cast("string"))).alias("roster_observed_url"))
    state = {"teams": teams, "memberships": bind.memberships(s, d), "team_matches": m.where("match_id % 3 = 0").select(source(3).alias("source_match_id"), *[F.col(c).cast("int") if c.endswith("won") else F.col(c) for c in fresh])}
    snapshots = bind.teams(s, d).select("team_id", F.concat(F.when(t % 4 == 1, "v").otherwise("u"), t.cast("string")).alias("url"), F.when(t % 8 != 0, day(t * 3 % 7)).alias("observed_at"))
    p = bind.players(s, d)
    seen = p.where("player_id % 3 <> 0").union(p.where("player_id % 10 = 1").withColumn("team_id", (t + 1) % 25))
    roster = seen.select("team_id", "name", F.when((F.col("player_id") % 10 == 7) & (t % 5 == 3), "ambiguous").otherwise("matched").alias("outcome"), "player_id")
    result = F.when(k % 5 == 0, "bye").when(k % 5 == 1, F.concat((k % 4).cast("string"), F.lit(" - "), (k % 3).cast("string"))).when(k % 5 != 4, F.concat((k % 3).cast("string"), F.lit("-"), (k % 4).cast("string")))
    schedule = m.where("match_id % 3 <> 0 AND match_id % 4 = 1").select(
        F.col("home_team_id").alias("team_id"), source(4).alias("source_match_id"), F.col("visiting_team_id").cast("string").alias("opponent"), F.lit("matched").alias("outcome"), F.col("visiting_team_id").alias("opponent_id"), "played_on", result.alias("result"), k.alias("seen"),
    )
    base = store.commit(state)
    after, said = pull.team_pulls(store.tables(base), snapshots, roster, schedule)
    store.commit({**after, "outcomes": said}, base)


_PULLS = f""", held AS (SELECT n_nationkey AS team_id, n_name AS team_name, CASE WHEN n_nationkey % 6 <> 0 THEN DATE '{bind.FIRST_DAY}' + n_nationkey % 5 END AS roster_observed_at, CASE WHEN n_nationkey % 6 <> 0 THEN 'u' || n_nationkey END AS roster_observed_url,
  CASE WHEN n_nationkey % 4 = 1 THEN 'v' ELSE 'u' END || n_nationkey AS url, CASE WHEN n_nationkey % 8 <> 0 THEN DATE '{bind.FIRST_DAY}' + n_nationkey * 3 % 7 END AS observed_at FROM nation),
seen AS (SELECT player_id, name, team_id FROM players WHERE player_id % 3 <> 0 UNION ALL SELECT player_id, name, (team_id + 1) % 25 FROM players WHERE player_id % 10 = 1),
bad AS (SELECT team_id, string_agg(DISTINCT 'roster: ' || name, '; ' ORDER BY 'roster: ' || name) AS ambiguous FROM seen WHERE player_id % 10 = 7 AND team_id % 5 = 3 GROUP BY 1),
judged AS (SELECT h.*, b.ambiguous, h.observed_at IS NOT NULL AND (h.roster_observed_at IS NULL OR h.observed_at > h.roster_observed_at) AS fresh,
  coalesce(h.observed_at > h.roster_observed_at AND h.roster_observed_url = h.url, false) AS trusted FROM held h LEFT JOIN bad b ON b.team_id = h.team_id)"""


@query(f"""{_PULLS} SELECT team_id, CASE WHEN ambiguous IS NULL AND fresh THEN observed_at ELSE roster_observed_at END AS roster_observed_at, CASE WHEN ambiguous IS NULL AND fresh THEN url ELSE roster_observed_url END AS roster_observed_url,
  CASE WHEN ambiguous IS NULL THEN 'pulled' ELSE 'refused' END AS outcome, ambiguous, CASE WHEN ambiguous IS NULL THEN trusted END AS trusted FROM judged""")
def team_pull_baselines(s, d):
    """Teams after their pulls, with outcomes: one ambiguous name refuses a team's whole pull."""
    store = _pulled(s, d)
    return store.read("teams").join(store.read("outcomes"), "team_id").select("team_id", "roster_observed_at", "roster_observed_url", "outcome", "ambiguous", "trusted")


@query(f"""{_PULLS}, obs AS (SELECT DISTINCT s.team_id, s.player_id, j.trusted FROM seen s JOIN judged j ON j.team_id = s.team_id WHERE j.ambiguous IS NULL)
SELECT m.player_id, m.team_id, m.event_id, CASE WHEN m.event_id IS NOT NULL OR NOT coalesce(j.trusted AND j.ambiguous IS NULL, false) THEN m.retired ELSE NOT EXISTS (SELECT 1 FROM obs o WHERE o.team_id = m.team_id AND o.player_id = m.player_id) END AS retired
FROM memberships m LEFT JOIN judged j ON j.team_id = m.team_id
UNION ALL SELECT player_id, team_id, NULL, false FROM obs o WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.event_id IS NULL AND m.team_id = o.team_id AND m.player_id = o.player_id)""")
def team_pull_members(s, d):
    """Members after the pulls: only trusted snapshots take members back and retire absent ones."""
    return _pulled(s, d).read("memberships")


@query(f"""{_PULLS}, stored AS (SELECT 'm' || (match_id // 3) AS source_match_id, event_id, home_team_id, visiting_team_id, played_on, home_courts_won, visiting_courts_won FROM team_matches WHERE match_id % 3 = 0),
told AS (SELECT 'm' || (match_id // 4) AS source_match_id, home_team_id, visiting_team_id, played_on, CASE match_id % 5 WHEN 1 THEN match_id % 4 WHEN 2 THEN match_id % 3 WHEN 3 THEN match_id % 3 END AS a, CASE match_id % 5 WHEN 1 THEN match_id % 3 WHEN 2 THEN match_id % 4 WHEN 3 THEN match_id % 4 END AS b
  FROM team_matches m JOIN judged j ON j.team_id = m.home_team_id WHERE j.ambiguous IS NULL AND match_id % 3 <> 0 AND match_id % 4 = 1)
SELECT coalesce(s.source_match_id, t.source_match_id) AS source_match_id, s.event_id, CASE WHEN t.source_match_id IS NULL THEN s.home_team_id ELSE t.home_team_id END AS home_team_id, CASE WHEN t.source_match_id IS NULL THEN s.visiting_team_id ELSE t.visiting_team_id END AS visiting_team_id,
  CASE WHEN t.source_match_id IS NULL THEN s.played_on ELSE t.played_on END AS played_on, CAST(CASE WHEN t.source_match_id IS NULL THEN s.home_courts_won ELSE t.a END AS INTEGER) AS home_courts_won, CAST(CASE WHEN t.source_match_id IS NULL THEN s.visiting_courts_won ELSE t.b END AS INTEGER) AS visiting_courts_won
FROM stored s FULL JOIN told t ON t.source_match_id = s.source_match_id""")
def team_pull_matches(s, d):
    """Team matches after the pulls: schedules of accepted pulls, their results as counts where they are two numbers."""
    return _pulled(s, d).read("team_matches")


@query(
    """WITH p AS (SELECT s_suppkey AS id, lower(s_name) AS key, CASE WHEN s_suppkey % 4 <> 0 THEN 't' || s_suppkey END AS tennis_id, s_nationkey % 3 AS g FROM supplier),
q AS (SELECT id AS request, key, CASE id % 3 WHEN 0 THEN 't' || id WHEN 1 THEN 'x' || id ELSE 't' || (id + 1) END AS tennis_id, CASE WHEN id % 5 <> 0 THEN CAST(id % 7 AS VARCHAR) END AS age_range FROM p WHERE id % 2 = 0)
SELECT q.request, CASE WHEN i.id IS NOT NULL THEN 'matched' ELSE 'name-only' END AS outcome, i.id AS id FROM q LEFT JOIN p i ON i.tennis_id = q.tennis_id""",
    base=False,
)
def archived_profile_outcomes(s, d):
    """Saved profiles: by their own id, by the id of another, or by a name only, which is refused."""
    return _profiles(s, d)[1]


@query(
    """WITH p AS (SELECT s_suppkey AS id, lower(s_name) AS key, CASE WHEN s_suppkey % 4 <> 0 THEN 't' || s_suppkey END AS tennis_id, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'old' END AS age_range FROM supplier),
q AS (SELECT id AS request, CASE id % 3 WHEN 0 THEN 't' || id WHEN 1 THEN 'x' || id ELSE 't' || (id + 1) END AS tennis_id, CASE WHEN id % 5 <> 0 THEN CAST(id % 7 AS VARCHAR) END AS age_range FROM p WHERE id % 2 = 0),
hit AS (SELECT p.id, max_by(q.age_range, q.request) FILTER (q.age_range IS NOT NULL) AS age_range FROM q JOIN p ON p.tennis_id = q.tennis_id GROUP BY 1)
SELECT p.id, p.tennis_id, coalesce(h.age_range, p.age_range) AS age_range FROM p LEFT JOIN hit h ON h.id = p.id""",
    base=False,
)
def archived_profile_players(s, d):
    """Players after saved profiles; what a page does not say stays."""
    return _profiles(s, d)[0].select("id", "tennis_id", "age_range")


def _profiles(s, d):
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    p = bind.read(s, d, "supplier")
    tagged = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    none = F.lit(None).cast("string")
    players = p.select(k.alias("id"), F.lower("s_name").alias("key"), F.when(k % 4 != 0, tagged("t", k)).alias("tennis_id"), F.when(nation % 3 != 0, "old").alias("age_range"), none.alias("gender"))
    own = F.when(k % 3 == 0, tagged("t", k)).when(k % 3 == 1, tagged("x", k)).otherwise(tagged("t", k + 1))
    pages = p.where(k % 2 == 0).select(k.alias("request"), F.lower("s_name").alias("key"), F.col("s_name").alias("name"), own.alias("tennis_id"), F.when(k % 5 != 0, (k % 7).cast("string")).alias("age_range"), none.alias("gender"))
    return pull.archived_profiles(pages, players, players.select("key", "id").limit(0))
