import random

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import grammar, markup, pagescan, publication, redact
from rallyframe.operators import ingest, merge
from rallyframe.plans import dossier
from rallyframe.sources import profiles, widgets


def table(*rows, tag="td"):
    return "<table class='x'>" + "".join("<tr>" + "".join(c if c.startswith("<t") else f"<{tag}>{c}</{tag}>" for c in r) + "</tr>" for r in rows) + "</table>"


def pages(spark, *docs):
    return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(docs)], "url string, html string")


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_player_header(spark):
    def page(who, level, dynamic="3.61<br>1/5/2026"):
        return table(("menu",)) + table((who, level), ("Estimated Dynamic Rating", dynamic)) + table(("Projected Year End Rating", "(3.70)"))

    got = by_url(profiles.player_header(pages(spark, page("Jo Day (Tulsa, OK)<br>Female", "4.0 c<br>12/31/2025"), page("Jo Day", "4.0 X<br>12/31/2025"), page("Jo Day<br>Other", "none", "-----"), "<p>", None)))
    r = got["u0"]
    assert (r["name"], r["location"], r["gender"], r["projected_rating"], r["error"]) == ("Jo Day", "Tulsa, OK", "Female", 3.7, None)
    assert tuple(r["ntrp"]) == (4.0, "C", "2025-12-31") and tuple(r["dynamic_rating"]) == (3.61, "2026-01-05")
    assert got["u1"]["error"] == "unknown rating type X"
    r = got["u2"]
    assert (r["name"], r["location"], r["gender"], r["ntrp"], r["dynamic_rating"], r["error"]) == ("Jo Day", None, None, None, None, None)
    assert got["u3"]["error"] == got["u4"]["error"] == "header not found"


def test_profile_tables(spark):
    teams = table(("Recent Team", "Type", "Section", "Gender", "Rating", "Match Start"), ("Net Gains", "Adult 18+", "Sec", "F", "4.0", "3/1/2026"), ("", "Adult", "", "", "", ""), ("short",))
    head = ("All Matches", "Total<br>Matches", "Win", "Loss", "W Pct", "Total Sets", "Win", "Loss", "W Pct", "Total Games", "Win", "Loss", "W Pct", "Defaults")
    seasons = table(head, ("2026", "3", "2", "1", "66%", "7", "5", "2", "71%", "60", "35", "25", "58%", "0"), ("Total", "x", *["1"] * 12))
    areas = table(("Current Playing Areas (Player Rating Lists)",), ("Tulsa",), ("",), ("Norman &amp; Moore",))
    docs = pages(spark, teams + seasons + areas, "<p>none</p>", table(head[:5] + ("Extra",) + head[5:]))
    got = {r["place"]: r for r in profiles.recent_teams(docs).collect()}
    assert (got[0]["team_name"], got[0]["match_start_on"], got[0]["error"]) == ("Net Gains", "2026-03-01", None)
    assert got[1]["error"] == "no team name" and got[2]["error"] == "row has 1 cells, expected 6" and len(got) == 3
    got = {(r["url"], r["place"]): r for r in profiles.season_records(docs).collect()}
    r = got["u0", 0]
    assert (r["year"], tuple(r["matches"]), tuple(r["sets"]), tuple(r["games"]), r["defaults"], r["error"]) == ("2026", (3, 2, 1), (7, 5, 2), (60, 35, 25), 0, None)
    assert got["u0", 1]["error"] == "not a count" and got["u1", None]["error"] == got["u2", None]["error"] == "table not found"
    assert [(r["place"], r["area"]) for r in profiles.playing_areas(docs).orderBy("place").collect()] == [(0, "Tulsa"), (2, "Norman & Moore")]


def test_team_page(spark):
    head = ("Name", "Location", "NTRP", "2026 Record", "Local Singles", "Local Doubles", "Local Record", "Rating")
    row = ("Jo Day", "Tulsa", "4.0C", "10-5", "1-0", "0-0", "-", "3.91")
    spread = ("Name", "<th colspan='2'>Postseason Record</th>") + head[1:]
    context = table(("Adult 18+ Missouri Valley M 4.0",), ("2026 Spring",), ("Net Gains",))
    docs = pages(
        spark, context + table(head, row, ("", *row[1:]), row[:3]), context.replace(" 18+", "") + table(spread, (row[0], "1-0", "x", *row[1:])), table((*head, "Shoe Size"), (*row, "44")), table(head[:-1], row[:-1]), table((*head, "Rating")), "<p>",
    )
    got = {(r["url"], r["place"]): r for r in profiles.team_roster(docs).collect()}
    for u in ("u0", "u1"):
        r = got[u, 0]
        assert (r["player_name"], r["location"], r["ntrp"], tuple(r["season"]), tuple(r["singles"]), tuple(r["doubles"]), r["local"], r["dynamic_rating"], r["error"]) == ("Jo Day", "Tulsa", "4.0C", (10, 5), (1, 0), (0, 0), None, 3.91, None)
    assert got["u0", 1]["error"] == "no name" and got["u0", 2]["error"] == "row has 3 cells, expected 8"
    assert [got[u, None]["error"] for u in ("u2", "u3", "u4", "u5")] == ["unknown column shoesize", "missing columns rating", "column given twice", "roster not found"]
    heads = by_url(profiles.team_header(docs))
    assert tuple(heads["u0"])[1:] == ("Net Gains", "2026 Spring", "Adult 18+", "Missouri Valley", "M", "4.0", None)
    assert tuple(heads["u1"])[3:] == (None, "Adult Missouri Valley", "M", "4.0", None) and heads["u5"]["error"] == "header not found"


def each(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_event_formats(spark):
    texts = ["S1:singles, D1 : doubles", "S1:singles,,D1:doubles", "S1", ":singles", "S1:mixed", "S1:singles,S1:doubles", "  ", None, "A:b:singles"]
    got = each(spark, texts, grammar.event_format)
    assert [tuple(c) for c in got[0]["courts"]] == [("S1", "singles"), ("D1", "doubles")]
    assert [r["error"] for r in got] == [None, "blank entry", "missing discipline", "blank slot", "unknown discipline", "slot given twice", "empty", "empty", "unknown discipline"]
    stored = spark.createDataFrame([([("S1", "singles")],), ([(" S1", "singles")],), ([],)], "c array<struct<slot: string, discipline: string>>")
    assert [r[0] for r in stored.select(grammar.is_canonical_format(F.col("c"))).collect()] == [True, False, False]


def test_league_scopes(spark):
    got = each(spark, ["exclude: Mixed ,Combo", "only:A:B", "Mixed", "but:Mixed", "only: ", "only:a,,b", "only:Mixed,ＭＩＸＥＤ", "", None], grammar.league_scope)
    assert got[0]["prefixes"] == ["Mixed", "Combo"] and (got[1]["mode"], got[1]["prefixes"]) == ("only", ["A:B"])
    assert [r["error"] for r in got[2:]] == ["missing mode", "unknown mode", "no prefix", "blank prefix", "prefix given twice", "empty", "empty"]


def test_small_texts(spark):
    assert each(spark, ["as of 3/4/26", "12/31/2025 x", "13-1", None], grammar.day_within) == ["2026-03-04", "2025-12-31", None, None]
    assert [r and tuple(r) for r in each(spark, ["10 - 5", "0-0", "1-2-3", "-"], grammar.win_loss)] == [(10, 5), (0, 0), None, None]
    links = ["/p.aspx?a=1&amp;name=Jo+Day", "?name=J%C3%B6", "?name=100%", "?name=&x=1", "?other=1", None]
    assert each(spark, links, lambda c: grammar.href_param(c, "name")) == ["Jo Day", "Jö", "100%", "", None, None]


VALUES = {"Jo Day": "Al Roe", "Ann & Co": "Jo & Day", "Day": "Night", "5": "6", "José Muñoz": "Rui Paz", "O'Neill": "Abbott"}
REDACTED = {
    "<script>Jo Day</script><a href='?n=Jo%20Day&m=jo+day'>JO DAY</a> Jo&nbsp;Day, Ann &amp; Co 5 <img src='data:image/png;charset=x;base64,AAAA' alt=5>": "<script></script><a href='?n=Al%20Roe&m=Al+Roe'>AL ROE</a> Al&nbsp;Roe, Jo &amp; Day 6 <img src='data:,' alt=6>",
    "&#74;o&#x20;D&#97y, J\u200bo\n\tDay": "Al&#x20;Roe, Al\n\tRoe",  # numeric references with and without their ends, invisible characters
    "Jose\u0301 MUÑOZ Jos%C3%A9+Mu%c3%b1oz JOSÉ&#32;MUÑOZ": "Rui Paz Rui+Paz RUI&#32;PAZ",  # composed and decomposed, percent codes
    "O&apos;Neill O&#39;NEILL O%27Neill": "Abbott ABBOTT Abbott",
    "Ann %26 Co, Ann+%26+Co, ANN &AMP; CO": "Jo %26 Day, Jo+%26+Day, JO &AMP; DAY",
    "50% &unknown; &#0; %ZZ Joday": "60% &unknown; &#0; %ZZ JoNight",
    "\ue000\ue001 Day": "\ue000\ue001 Night",  # private-use characters are none of its business
}


def test_redaction(spark):
    df = spark.createDataFrame([(p, 1) for p in [*REDACTED, "", None]], "html string, keep int").withColumn("was", F.col("html"))
    got = {r["was"]: r["html"] for r in redact.redacted(df, VALUES).collect()}
    assert got == {**REDACTED, "": "", None: None}
    assert redact.survivors(df.select(F.col("keep").alias("page_id"), F.col("html")), ["José Muñoz"]).where("view = 'raw'").first()["n"] == 3
    for bad in ({"Jo": "<b>"}, {"Jo": "A&B"}, {" \u200b": "x"}):
        with pytest.raises(ValueError):
            redact.redacted(df, bad)


def test_every_spelling_of_every_character_is_found():
    from urllib.parse import quote

    value = "Zoë O'Day & Sons"
    spellings = [lambda c: c, lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):X};", lambda c: quote(c, safe=""), lambda c: "".join(f"%{b:02x}" for b in c.encode()), lambda c: c.upper()]
    matcher = redact.Matcher([value])
    for a in spellings:
        for b in spellings:
            page = "x " + "".join((a if k % 2 else b)(c) for k, c in enumerate(value)) + " y"
            assert [v for _, _, v in matcher.find(page)[0]] == [value], page
            assert redact.substituted(page, matcher, {value: "Q"}) == "x Q y"


def test_skeletons_and_classes(spark):
    kept = {
        "José Muñoz 4.02": "José Muñoz", "on 1/15/2026 and 2026-01-15 6-4, 7-6(7) 10-8 (10-8)": "on and", "#fff #a1B2c3 #abcd x": "abcd x", "Lee Leeson lee": "Leeson", "Straße_9 4.0M 日本": "Straße_9 0M 日本", "M0 10L-4 5z ok": "z ok", "Court 7": "Cour", "": "",
    }
    df = spark.createDataFrame([(t,) for t in kept], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", markup.skeleton(F.col("t"), ["Lee"]).alias("s")).collect()} == kept
    assert each(spark, ["patrick turner", "José García", "O'Neil  Ann-Lee", "single", "x 1 y", None], markup.needs_review) == [True, True, True, False, False, None]
    hits = {
        "mail a.b+c@ex-am.co.uk now": {"email": "a.b+c@ex-am.co.uk"}, "<a href='MAILTO:jo%20day@x.org?subject=hi'>": {"mailto": "MAILTO:jo%20day@x.org?subject=hi", "email": "day@x.org"}, "tel:+1-918-55501 ": {"tel": "tel:+1-918-55501"},
        "call (918) 555-0101 or 918.555.0102": {"phone": "(918) 555-0101"}, "x1918-555-01012": {}, "at 12 Old Mill Road, and": {"street": "12 Old Mill Road"}, "12 monkeys Way": {}, "@ a@b no.mail@": {},
    }
    docs = spark.createDataFrame(list(enumerate(hits)), "doc_id long, text string")
    got = {i: {} for i in range(len(hits))}
    for r in markup.first_hits(docs).collect():
        got[r["doc_id"]][r["class"]] = r["hit"]
    assert [got[i].get("email") if "MAILTO" in t else got[i] for i, t in enumerate(hits)] == [got[i].get("email") if "MAILTO" in t else want for i, (t, want) in enumerate(hits.items())]
    assert got[1]["mailto"] == "MAILTO:jo%20day@x.org?subject=hi"


def test_closed_attribute_values():
    cases = {
        ("colspan", "2"): True, ("colspan", "2 Jo"): False, ("width", "12.5px"): True, ("width", "Jo"): False, ("viewbox", "0 0 24 24"): True, ("viewbox", "0 0 24"): False, ("d", "M0 0L4,4z"): True, ("d", "Jo Day"): False, ("fill", "#FFF"): True,
        ("fill", "url(#jo)"): False, ("type", "Hidden"): True, ("type", "jo"): False, ("title", "2"): False, ("transform", "translate(1 2) rotate(45)"): True, ("transform", "jo(1)"): False, ("points", "1,2 3,4"): True, ("role", "button"): True, ("xmlns", "http://www.w3.org/2000/svg"): True,
    }
    assert {(n, v): markup.is_closed(n, v) for n, v in cases} == cases


def test_publication_check_shows_the_first_stage(spark):
    rows = [
        (1, "<p>Kestrel Avery</p><b>6-4</b>"), (2, "<input type=hidden name=csrf value=abc><p>Jo Day</p>"), (3, "<p>Somebody Else</p> a@b.org"), (4, "<p>known words</p><i>tel:918 555 0101</i>"), (5, "<p>known words</p><a title='Ann&#32;Co'></a>"), (6, "<td colspan=2>known words</td>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    known = spark.createDataFrame([("known words",), ("tel",), ("Ann 32 Co",), ("Ann Co",), ("Ann Co",)], "skeleton string")
    got = publication.publication_check(pages, ["Kestrel Avery"], known, redact.survivors(pages, ["Ann Co"])).collect()
    assert {(r["page_id"], r["stage"]) for r in got} == {(2, "credential"), (3, "vocabulary"), (4, "class"), (5, "forbidden")}


def test_views(spark):
    page = "<!-- Jo&#32;Day --><a title='J&ouml;'>a%20b&amp;amp;</a>\u200bx"
    raw, decoded, shown, percent = redact.views(page)
    assert raw == page and "Jo Day" in decoded and "a b" in percent and shown == "Jo Day Jö a%20b&amp; x"


def test_members_are_replaced(spark):
    schema = "player_id int, team_id int, event_id int, retired boolean"
    stored = spark.createDataFrame([(1, 1, 1, False), (2, 1, 1, True), (3, 1, 1, False), (3, 1, None, False), (4, 2, 1, False)], schema)
    named = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (5, 1, 1), (5, 1, 1)], "player_id int, team_id int, event_id int")
    got = sorted(map(tuple, merge.replace_members(stored, named).collect()), key=str)
    assert got == sorted([(1, 1, 1, False), (2, 1, 1, False), (3, 1, 1, True), (3, 1, None, False), (4, 2, 1, False), (5, 1, 1, False)], key=str)
    assert sorted(map(tuple, merge.replace_members(stored, named.limit(0)).collect()), key=str) == sorted(map(tuple, stored.collect()), key=str)


def test_answers(spark):
    attempts = spark.sql("SELECT * FROM VALUES (1, 1, DATE '2024-01-01'), (2, 1, DATE '2024-01-02'), (3, 1, DATE '2024-01-09'), (4, 9, DATE '2024-01-01') t(attempt, player_id, day)")
    events = spark.sql("SELECT * FROM VALUES (1, DATE '2024-01-01', DATE '2024-01-02'), (2, DATE '2024-01-02', DATE '2024-01-03'), (3, DATE '2024-01-09', DATE '2024-01-08') t(event_id, starts_on, ends_on)")
    got = {r["attempt"]: (r["outcome"], r["event_id"]) for r in ingest.answer_outcomes(attempts, spark.createDataFrame([(1,), (1,)], "player_id int"), events).collect()}
    assert got == {1: ("recorded", 1), 2: ("ambiguous event", None), 3: ("no event", None), 4: ("not a member", None)}


def test_counts_are_compared(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("z",)], "k string")
    assert sorted(map(tuple, merge.compare_counts(a, b, "k").collect())) == [("x", 2, 1, False), ("y", 1, 0, False), ("z", 0, 1, False)]


def section(title, value, *subtitles, extra=""):
    k = "v-form-wtn-widget__section"
    return f"<div class='a {k} b'><p class='{k}-title'>{title}</p><p class='{k}-value'><b>{value}</b></p>" + "".join(f"<p class='{k}-subtitle'>{x}</p>" for x in subtitles) + extra + "</div>"


def widget(*sections):
    return "<div class='v-form-wtn-widget'>" + "".join(sections) + "<a class='v-form-wtn-widget__navigation-link' href='/p?x=1&amp;tennis-id=ABC1'>x</a></div>"


def test_rating_widget(spark):
    zone = "<p class='v-form-wtn-widget__section-zone'>Game zone 30.87 to 27.40</p><p class='v-form-wtn-widget__section-confidence'>High</p>"
    good = section("WTN Singles", "29.1", "Updated 7/1/26", "Last played 6/30/2026", extra=zone)
    docs = pages(
        spark, widget(good, section("WTN Doubles", "31", "updated 07/02/2026"), section("", "")), "<p>no widget</p>", widget(good) * 2, widget(good, good), widget(section("WTN Singles", "--", "Updated 7/1/26")),
        widget(section("WTN Mixed", "3")), widget(section("WTN Doubles", "31", "soon")), widget(section("WTN Doubles", "31", "Updated 7/1/26", "Updated 7/2/26")), None,
    )
    got = by_url(widgets.rating_widget(docs))
    r = got["u0"]
    assert r["error"] is None and r["tennis_id"] == "ABC1" and tuple(r["singles"]) == (29.1, "High", 30.87, 27.4, "2026-07-01", "2026-06-30") and tuple(r["doubles"]) == (31.0, None, None, None, "2026-07-02", None)
    assert tuple(got["u1"])[1:] == tuple(got["u8"])[1:] == (None, None, None, None)
    assert [got[f"u{i}"]["error"] for i in range(2, 8)] == ["several widgets", "section given twice", "no value", "unknown section", "no date", "date given twice"]


def test_identity_page(spark):
    block = "<div class='x playerDetailsHeader_a1'><h2> Jo  Day</h2><p>Female|41-50|</p><p>other</p></div>"
    rows = [("u?tennis-id=A1", block), ("u", block), ("u?tennis-id=A2", "<p>"), ("u?tennis-id=A3", block * 2), ("u?tennis-id=A4", block.replace("|41", "41")), ("u?tennis-id=A5", block.replace("other", "Male|18|")), ("u?tennis-id=A6", block.replace("41-50", " "))]
    got = by_url(widgets.identity_page(spark.createDataFrame(rows, "url string, html string")))
    assert tuple(got["u?tennis-id=A1"])[1:] == ("A1", "Jo Day", "Female", "41-50", None)
    assert [got[u]["error"] for u, _ in rows[1:]] == ["no tennis-id", "identity not found", "several identities", "no identity line", "several identity lines", "no age range"]


def test_html_dossier_escapes(spark):
    teams = spark.createDataFrame([(1, "A & <B>"), (2, "None")], "team_id int, team_name string")
    won = spark.createDataFrame([(1, 2, 1)], "team_id int, wins int, losses int")
    roster = spark.createDataFrame([(1, 7, "Jo 'x' Day")], "team_id int, player_id int, name string")
    text = {r["team_id"]: r["text"] for r in dossier.html(teams, won, roster, spark.createDataFrame([(7, 3, 1, 0)], "player_id int, wins int, losses int, undecided int")).collect()}
    assert "<h1>A &amp; &lt;B&gt;</h1>" in text[1] and "<td>Jo &#39;x&#39; Day</td><td>3-1</td><td>0</td>" in text[1] and "no players recorded" in text[2]


PIECES = ("<p>", "</p >", "<td colspan='2' title=\"Jo <b> Day\">", "<br/>", "words ", " < 3", "<!-- note -->", "<!DOCTYPE html>", "<!doctype x>", "<?pi z?>", "<script>var a = '<p>';</script>", "<title>a<b</title>", "<jo-day x=1>", "<a href=jo data-jo-day=2 jo>", "</a jo=day>", "é&eacute;\n", "<input value='", "'>", "<", ">", "</", "<!--", "\"")


def random_pages(n):
    rng = random.Random(17)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_every_character_of_a_page_is_covered_or_an_atom():
    for page in random_pages(3000):
        scanner = pagescan.Scanner(page, markup.is_closed)
        found = list(scanner.tokens())
        seen = bytearray(len(page))
        for a, b in scanner.covered:
            seen[a:b] = b"\1" * (b - a)
        for g in scanner.gaps():
            seen[g.start : g.end] = b"\1" * (g.end - g.start)
        assert not "".join(c for c, s in zip(page, seen) if not s and c not in pagescan.DELIMITERS).strip(), page
        assert all(page[a.start : a.end] == a.value for a in found)


def test_a_word_planted_anywhere_in_a_page_is_in_an_atom():
    rng = random.Random(23)
    for page in random_pages(3000):
        at = rng.randint(0, len(page))
        for word in ("Zqx", " Zqx ", "&Zqx"):
            said = page[:at] + word + page[at:]
            assert any("Zqx" in a.value for a in pagescan.atoms(said, markup.is_closed)), said


def test_atoms_of_a_page_outside_its_tags(spark):
    page = 'Jane Doe<p>x</p><!DOCTYPE a "Jane Doe"><jane-doe data-jane=1></p doe="1"><td width=4 width=Jane><!-- Jane Doe'
    got = {(r["kind"], r["name"], r["value"]) for r in markup.page_atoms(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()}
    assert got == {
        ("text", None, "Jane Doe"), ("text", None, "x"), ("directive", None, 'DOCTYPE a "Jane Doe"'), ("element-name", None, "jane-doe"), ("attribute-name", None, "jane"), ("attribute", "data-jane", "1"),
        ("discarded", None, "doe"), ("discarded", None, "1"), ("attribute", "width", "Jane"), ("unfinished", None, "<!-- Jane Doe"),
    }
    pages = spark.createDataFrame([(1, "Jane Doe<p>x</p>"), (2, '<!DOCTYPE a "Jane Doe"><p>x</p>'), (3, "<p>x</p><!-- Jane Doe"), (4, "<p>x</p><p title=Jane"), (5, "<!doctype html><p>x</p>"), (6, "<p>x</p><p>&#106;&#x40;b.org</p>"), (7, "<p>x</p>918%2D555%2D0101")], "page_id long, html string")
    known = spark.createDataFrame([("x",), ("j b org",)], "skeleton string")
    none = spark.createDataFrame([], "page_id long, value string")
    got = {r["page_id"]: (r["stage"], r["detail"]) for r in publication.publication_check(pages, [], known, none).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "vocabulary", 2: "vocabulary", 3: "vocabulary", 4: "vocabulary", 6: "class", 7: "class"} and got[6][1] == "email" and got[7][1] == "phone"


def test_skeletons_are_the_same_in_every_spelling(spark):
    texts = ["José García", "Jos&eacute; Garc&#237;a", "Jose\u0301 Garci\u0301a", "Jos%C3%A9%20Garc%C3%ADa", "José\u200bGarcía", "José &amp;amp;  García", "100% José García 6-4, 7-6(7) #fff M10 20L3.5,4 1/15/2026"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(markup.skeleton(F.col("t")).alias("s")).collect()]
    assert got[:4] == ["José García"] * 4 and got[4:6] == ["José García"] * 2 and got[6] == "José García"
    assert [r["s"] for r in spark.createDataFrame([(None,), ("",)], "t string").select(markup.skeleton(F.col("t")).alias("s")).collect()] == [None, ""]


def test_shown_identities_within_reach_of_a_mark(spark):
    rows = [
        (1, '<b data-element-name="fullName"></b>' + "." * 350 + "<h3 class=x>Jo Day</h3><h3>Other</h3>"), (2, '<b data-element-name="fullName"></b>' + "." * 420 + "<h3>Jo Day</h3>"), (3, '<div class="a playerDetailsHeader___p1"><h2>jo day</h2></div>'),
        (4, '<p data-element-name="nameGenderAddress"><span>F</span> | Tulsa, OK <br>'), (5, '<img src="/User/01234567-89ab-cdef-0123-456789abcdef/x.png">'), (6, "<h3>Jo Day</h3>"), (7, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    want = {(1, "displayed name", "Jo Day"), (3, "displayed profile", "jo day"), (4, "displayed location", "Tulsa, OK"), (5, "avatar asset", "01234567-89ab-cdef-0123-456789abcdef")}
    assert set(map(tuple, publication.displayed(pages).collect())) == want
    allowed = spark.createDataFrame([("JO DAY",)], "value string")
    assert set(map(tuple, publication.unlisted(pages, allowed).collect())) == {w for w in want if w[2].lower() != "jo day"}


def test_characters_of_a_page_are_kept_in_runs():
    page = "<p>Grün ist\n  J&ouml; Day</p>" + "Wörter und Wörter. " * 5000
    chars, starts = redact.characters(page)
    assert chars == "<p>Grün ist Jö Day</p>" + "Wörter und Wörter. " * 5000 and len(starts.firsts) == 6  # five, and the end
    assert all(page[starts[k]] == c for k, c in enumerate(chars) if c not in "ö ") and page[starts[13] : starts[14]] == "&ouml;" and starts[len(chars)] == len(page)


def test_every_spelling_is_found_as_before():
    rng = random.Random(31)
    pieces = (" ", "  ", "\n", " ", "\u200b", "\u00ad", "é", "\u0130", "\u03a3", "&#32;", "&eacute;", "&#1114112;", "%C3%A9", "%ff", "+", "Jun", "JUN", "<", "&amp;", "x", "Ж")
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        chars, starts = redact.characters(page)
        assert redact._lowered(chars) == "".join(map(redact._lower, chars))
        assert "  " not in chars and [starts[k] for k in range(len(chars) + 1)] == sorted({starts[k] for k in range(len(chars) + 1)}) and starts[len(chars)] == len(page)


def test_pages_are_dealt_out_before_python(spark):
    from rallyframe.plans import publishing

    for query in (publishing.forbidden_survivors, publishing.redaction_leaks):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_publication_check_redacts_and_reads_pages_once(spark):
    from rallyframe.plans import publishing

    plan = publishing.publication_check(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "substitute(" not in plan and plan.count("MapInArrow") == 2  # classes; marks and texts


def test_nearest_text_behind_a_mark(spark):
    rows = [
        (1, '<i data-element-name="fullName"></i><h3>Ann</h3><h3>Bea</h3>'), (1, '<i data-element-name="fullName"></i><h3>Abe</h3>'), (2, '<h3>Cat</h3><i data-element-name="fullName"></i>'),
        (3, '<i data-element-name="fullName"></i>' * 2 + "x" * 380 + "<h3>Dan</h3>"), (4, '<i data-element-name="fullName"></i>' + "x" * 420 + "<h3>Eve</h3>"), (5, '<h2 class="playerDetailsHeader">Flo</h2><h2>Gus</h2>'), (6, None),
    ]
    got = sorted(map(tuple, publication.displayed(spark.createDataFrame(rows, "page_id long, html string")).collect()))
    assert got == [(1, "displayed name", "Abe"), (3, "displayed name", "Dan"), (5, "displayed profile", "Gus")]
