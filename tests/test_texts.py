"""Printed lines, how players play, write-ups and stored scopes."""

from pyspark.sql import functions as F

from rallyframe.functions import grammar
from rallyframe.operators import printed, ratings, upkeep
from rallyframe.plans import dossier


def test_aliases_and_ambiguities_on_one_line(spark):
    players = spark.createDataFrame([(1, "Ann Co"), (2, "Bo"), (3, "Cy")], "player_id long, name string")
    aliases = spark.createDataFrame([(1, 1, " ANN CO"), (1, 3, "Annie​"), (1, 2, "annie"), (1, 4, "A. Co"), (2, 1, "bo ")], "player_id long, alias_id long, alias string")
    assert {r["player_id"]: r["text"] for r in printed.alias_lines(players, aliases).collect()} == {1: "annie, A. Co"}
    found = spark.createDataFrame([(1, 2, "Jo", "team", ["Jon", "Joe"]), (2, 2, "B", "court", ["Bo"]), (2, 1, "A", "roster", [])], "pull long, place long, incoming string, context string, candidates array<string>")
    assert {r["pull"]: r["text"] for r in printed.ambiguity_lines(found, "pull").collect()} == {1: 'ambiguous identity "Jo" (team) — near: Jon, Joe', 2: '2 ambiguous identities — [1] "A" (roster) — near: ; [2] "B" (court) — near: Bo'}


def test_how_players_play(spark):
    requests = [(1, 1, "both", "matched", 10), (2, 1, "doubles-only", "matched", 11), (3, 1, "Both", "matched", 10), (4, 1, None, "matched", 10), (5, 1, "both", "ambiguous", None), (6, 1, "both", "created", None), (7, 2, "both", "matched", 10), (8, 1, "doubles-only", "matched", 10)]
    said = upkeep.plays_outcomes(spark.createDataFrame(requests, "request long, team_id int, plays string, outcome string, id long"), spark.createDataFrame([(1, 10), (1, 11), (1, 11)], "team_id int, player_id long"))
    assert {r["request"]: r["outcome"] for r in said.collect()} == {1: "set", 2: "set", 3: "invalid value", 4: "invalid value", 5: "ambiguous", 6: "unknown player", 7: "not on the roster", 8: "set"}
    players = spark.createDataFrame([(10, "x", None), (11, "y", "both"), (12, "z", "both")], "player_id long, name string, plays string")
    assert {r["player_id"]: r["plays"] for r in upkeep.set_plays(players, said).collect()} == {10: "doubles-only", 11: "doubles-only", 12: "both"}
    words = {"Competition Category: MALE": "Male", "female": "Female", "Male": "Male", "x": "x", None: None}
    got = upkeep.backfilled_genders(spark.createDataFrame([(w, w) for w in words], "w string, gender string")).collect()
    assert {r["w"]: r["gender"] for r in got} == words


def test_stored_scopes_fail_closed(spark):
    cases = {
        '{"mode":"exclude","prefixes":["Mixed"]}': None, '{"prefixes":["A","B"],"mode":"only"}': None, "": "not JSON", "null": "malformed", "7": "malformed", '{"mode":"only"}': "malformed", '{"mode":"only","prefixes":"A"}': "malformed", '{"mode":"only","prefixes":[null]}': "malformed",
        '{"mode":"only","prefixes":["A","ａ"]}': "prefix given twice", '{"mode":"only","prefixes":["A "]}': "not canonical", '{"mode":"Only","prefixes":["A"]}': "malformed", '{"mode":"only","prefixes":["A"],"more":null}': "malformed", None: None,
    }
    got = {r["raw"]: r["s"] for r in spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", grammar.stored_scope(F.col("raw")).alias("s")).collect()}
    assert {k: v["error"] for k, v in got.items()} == cases
    assert all((v["mode"] is None) == (k is None or cases[k] is not None) for k, v in got.items()) and got['{"prefixes":["A","B"],"mode":"only"}']["prefixes"] == ["A", "B"]


def test_player_write_ups(spark):
    players = spark.createDataFrame([(1, "Ann | Co"), (2, "<Bo>")], "player_id long, name string")
    windowed = spark.createDataFrame([(1, "singles", 3, 1, 0), (1, "doubles", 0, 2, 1)], "player_id long, discipline string, wins long, losses long, undecided long")
    slots = spark.createDataFrame([(1, "S2", 1), (1, "S1", 1), (1, "D1", 3)], "player_id long, slot string, matches long")
    partners = spark.createDataFrame([(1, 2, 3)], "player_id long, partner_id long, matches long")
    facts = dossier.player_facts(players, windowed, slots, partners)
    text = {r["player_id"]: r["text"] for r in dossier.player_blocks(facts, "2026").collect()}
    assert text[1] == "### Ann \\| Co\n\n**Record (2026):** singles 3-1, doubles 0-2 (1 undecided)\n\n**Court-slot tendencies:** D1×3, S1×1, S2×1\n\n**Partner frequency:** <Bo> ×3"
    assert text[2].endswith("**Record (2026):** singles 0-0, doubles 0-0\n\n**Court-slot tendencies:** none\n\n**Partner frequency:** none")
    page = {r["player_id"]: r["text"] for r in dossier.player_articles(facts, "2026").collect()}
    assert "<p>Partners: &lt;Bo&gt; ×3</p>" in page[1] and "<h3>&lt;Bo&gt;</h3>" in page[2]


def test_ranks_in_two_steps_equal_an_order(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randint(1, 3), p, rng.choice((None, 1.0, 2.5, 3.25, 3.25))) for p in range(60)]
    roster = spark.createDataFrame([(t, p) for t, p, _ in rows], "team_id int, player_id long")
    last = spark.createDataFrame([(p, "s", v) for _, p, v in rows if v is not None], "player_id long, source string, value double")
    chosen = spark.createDataFrame([(t, "s") for t in (1, 2, 3)], "team_id int, source string")
    for inverted in ([], ["s"]):
        got = {r["player_id"]: r["rank"] for r in ratings.roster_rank(roster, last, chosen, inverted).collect()}
        for t in (1, 2, 3):
            known = sorted((v if inverted else -v, p) for u, p, v in rows if u == t and v is not None)
            want = {p: k for k, (_, p) in enumerate(known)} | {p: len(known) for u, p, v in rows if u == t and v is None}
            assert {p: got[p] for u, p, _ in rows if u == t} == want
