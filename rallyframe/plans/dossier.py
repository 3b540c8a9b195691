"""Team dossiers: text assembled by joins of per-operator frames, written one folder for each team."""

from __future__ import annotations

from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import slug
from rallyframe.functions.phrases import escape_html, partners_line, record, safe, slots_line
from rallyframe.sources import dossier_sink


def directory_names(teams: DataFrame) -> DataFrame:
    """A folder name for each team: its slug, or ``team-<id>`` where that is empty.

    In order of ids, a team whose slug is taken has its id behind it, and if that is taken too, -2, -3 and
    so on. What is put behind a shared slug can only meet slugs that go on from it by numbers. So a
    slug of one team, none of whose beginnings is shared, stays; where teams share a slug and no other
    goes on from it, the first has it and each other one has its id behind it. Only the teams of a
    shared slug that another goes on from are walked in order, in one task for each such slug.
    """
    s = slug(F.col("team_name"))
    named = teams.select("team_id", F.when(s == "", F.concat(F.lit("team-"), F.col("team_id").cast("string"))).otherwise(s).alias("slug"))
    shared = named.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select(F.col("slug").alias("root"))
    # The slug and its beginnings without one, two, ... of the numbers at its end; the shortest that is shared.
    parts = F.split("slug", "-")
    numbers = F.aggregate(F.reverse(parts), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, p: F.struct((a["n"] + F.when(a["on"] & p.rlike("^[0-9]+$"), 1).otherwise(0)).alias("n"), (a["on"] & p.rlike("^[0-9]+$")).alias("on")))["n"]
    begun = F.transform(F.sequence(F.lit(0), F.least(numbers, F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "-"))
    roots = named.select("team_id", "slug", F.explode(begun).alias("root")).join(shared, "root").groupBy("team_id", "slug").agg(F.min(F.struct(F.length("root").alias("l"), "root"))["root"].alias("root"))
    kept = named.join(roots.select("team_id"), "team_id", "leftanti").select("team_id", F.col("slug").alias("directory"))
    groups = roots.groupBy("root").agg(F.min("team_id").alias("first"), F.max((F.col("slug") != F.col("root")).cast("int")).alias("mixed"))
    placed = roots.join(groups, "root")
    plain = placed.where("mixed = 0").select("team_id", F.when(F.col("team_id") == F.col("first"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("team_id").cast("string"))).alias("directory"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for team, own in group.sort_values("team_id")[["team_id", "slug"]].itertuples(index=False):
            options = chain([own, f"{own}-{team}"], (f"{own}-{team}-{k}" for k in count(2)))
            out.append((team, next(name for name in options if name not in used)))
            used.add(out[-1][1])
        return pd.DataFrame(out, columns=["team_id", "directory"])

    return kept.union(plain).union(placed.where("mixed = 1").select("root", "team_id", "slug").groupBy("root").applyInPandas(walk, kept.schema))


def escape_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"([|\\])", r"\\$1")


def _tally(wins: str, losses: str) -> Column:
    return F.concat_ws("-", F.coalesce(wins, F.lit(0)).cast("string"), F.coalesce(losses, F.lit(0)).cast("string"))


def _gathered(teams: DataFrame, team_records: DataFrame, rosters: DataFrame, records: DataFrame, line: Column) -> DataFrame:
    """Teams with their record and ``rows``, the lines of their players in order of name. A team's roster bounds what is gathered for it."""
    total = records.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "undecided")])
    lines = rosters.join(total, "player_id", "left").groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "player_id", line.alias("line")))).alias("rows"))
    return teams.join(team_records, "team_id", "left").join(lines, "team_id", "left")


def _section(t: DataFrame, sections: dict[str, DataFrame] | None) -> tuple[DataFrame, list[str]]:
    """Teams with a column for each section (frames of team_id and text), and the sections' titles."""
    names = []
    for title, frame in (sections or {}).items():
        names.append(title)
        t = t.join(frame.select("team_id", F.col("text").alias(f"__{len(names)}")), "team_id", "left")
    return t, names


def markdown(teams: DataFrame, team_records: DataFrame, rosters: DataFrame, records: DataFrame, sections: dict[str, DataFrame] | None = None) -> DataFrame:
    """team_id and its Markdown dossier; ``sections`` (title: team_id and text) follow the table of players, ``_None recorded._`` where a team has no text."""
    line = F.concat(F.lit("| "), escape_cell(F.col("name")), F.lit(" | "), _tally("wins", "losses"), F.lit(" | "), F.coalesce("undecided", F.lit(0)).cast("string"), F.lit(" |"))
    t, titles = _section(_gathered(teams, team_records, rosters, records, line), sections)
    table = F.coalesce(F.array_join(F.transform("rows", lambda r: r.line), "\n"), F.lit("no players recorded"))
    head = F.concat(F.lit("# "), escape_cell(F.col("team_name")), F.lit("\n\nRecord: "), _tally("wins", "losses"), F.lit("\n\n| Player | Record | Undecided |\n| --- | --- | --- |\n"))
    more = [F.concat(F.lit(f"\n\n## {title}\n\n"), F.coalesce(f"__{k + 1}", F.lit("_None recorded._"))) for k, title in enumerate(titles)]
    return t.select("team_id", F.concat(head, table, *more, F.lit("\n")).alias("text"))


def html(teams: DataFrame, team_records: DataFrame, rosters: DataFrame, records: DataFrame, sections: dict[str, DataFrame] | None = None) -> DataFrame:
    """team_id and its dossier as a page; every text from the data is escaped."""
    line = F.concat(F.lit("<tr><td>"), escape_html(safe(F.col("name"))), F.lit("</td><td>"), _tally("wins", "losses"), F.lit("</td><td>"), F.coalesce("undecided", F.lit(0)).cast("string"), F.lit("</td></tr>"))
    t, name = _gathered(teams, team_records, rosters, records, line), escape_html(safe(F.col("team_name")))
    t, titles = _section(t, sections)
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: r.line), "\n"), F.lit("<tr><td colspan='3'>no players recorded</td></tr>"))
    head = F.concat(F.lit("<!doctype html>\n<meta charset='utf-8'>\n<title>"), name, F.lit("</title>\n<h1>"), name, F.lit("</h1>\n<p>Record: "), _tally("wins", "losses"), F.lit("</p>\n<table>\n<tr><th>Player</th><th>Record</th><th>Undecided</th></tr>\n"))
    more = [F.concat(F.lit(f"<h2>{title}</h2>\n<pre>"), F.coalesce(escape_html(F.col(f"__{k + 1}")), F.lit("None recorded.")), F.lit("</pre>\n")) for k, title in enumerate(titles)]
    return t.select("team_id", F.concat(head, rows, F.lit("\n</table>\n"), *more).alias("text"))


def player_facts(players: DataFrame, windowed: DataFrame, slots: DataFrame, partners: DataFrame) -> DataFrame:
    """player_id, name and the lines of its write-up: singles and doubles (records), slots and partners.

    ``windowed``: player_id, discipline, wins, losses, undecided; ``slots``: player_id, slot, matches; ``partners``: player_id,
    partner_id, matches. What is gathered for a player is what its own write-up prints.
    """
    said = {}
    for kind in ("singles", "doubles"):
        sums = [F.coalesce(F.sum(F.when(F.col("discipline") == kind, F.col(c))), F.lit(0)) for c in ("wins", "losses", "undecided")]
        said[kind] = record(*sums).alias(kind)
    records = windowed.groupBy("player_id").agg(*said.values())
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("k"), F.col("slot").alias("t"), "slot", "matches")))
    tended = slots.groupBy("player_id").agg(slots_line(by_count).alias("slots"))
    names = players.select(F.col("player_id").alias("partner_id"), "name")
    met = F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("k"), "partner_id", "name", "matches")))
    stood = partners.join(names, "partner_id").groupBy("player_id").agg(partners_line(met).alias("partners"))
    out = players.select("player_id", "name").join(records, "player_id", "left").join(tended, "player_id", "left").join(stood, "player_id", "left")
    return out.fillna("0-0", ["singles", "doubles"]).fillna("none", ["slots", "partners"])


def player_blocks(facts: DataFrame, window: str) -> DataFrame:
    """player_id and its write-up in Markdown."""
    text = F.concat(
        F.lit("### "), escape_cell(safe(F.col("name"))), F.lit(f"\n\n**Record ({window}):** singles "), "singles", F.lit(", doubles "), "doubles", F.lit("\n\n**Court-slot tendencies:** "), "slots", F.lit("\n\n**Partner frequency:** "), escape_cell(F.col("partners"))
    )
    return facts.select("player_id", text.alias("text"))


def player_articles(facts: DataFrame, window: str) -> DataFrame:
    """player_id and its write-up as a part of a page; every text from the data is escaped."""
    text = F.concat(
        F.lit("<article>\n<h3>"), escape_html(safe(F.col("name"))), F.lit(f"</h3>\n<p>Record ({window}): singles "), "singles", F.lit(", doubles "), "doubles", F.lit("</p>\n<p>Court slots: "), escape_html(F.col("slots")), F.lit("</p>\n<p>Partners: "), escape_html(F.col("partners")), F.lit("</p>\n</article>")
    )
    return facts.select("player_id", text.alias("text"))


def list_section(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """team_id and text: one line for each row of a team, in order."""
    return rows.groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))).alias("l")).select("team_id", F.array_join(F.transform("l", lambda x: x["__line"]), "\n").alias("text"))


def index(field: DataFrame, teams: DataFrame, directories: DataFrame, team_records: DataFrame) -> DataFrame:
    """event_id and the index page of its field (team_id, event_id): a line for each team in order of name, with its folder and record."""
    t = field.join(teams.select("team_id", "team_name"), "team_id").join(directories, "team_id").join(team_records, "team_id", "left")
    line = F.concat(F.lit("- ["), escape_cell(F.col("team_name")), F.lit("]("), "directory", F.lit("/dossier.md) "), _tally("wins", "losses"))
    rows = F.array_sort(F.collect_list(F.struct(F.lower("team_name").alias("k"), "team_id", line.alias("line"))))
    return t.groupBy("event_id").agg(rows.alias("l")).select("event_id", F.concat(F.lit("# Field\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write(dossiers: DataFrame, directories: DataFrame, path: str) -> None:
    """Replace the dossiers at ``path`` by these, in the folder of each team; a bad one leaves all as it was (``dossier_sink``)."""
    dossier_sink.write(dossiers.join(directories, "team_id").select("directory", "text"), path)
