"""Texts of several lines, for all teams and players at once: lineup plans, aliases, ambiguities.

Lines are made row by row and joined in order; what is gathered for a text is what it prints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import name_key
from rallyframe.functions.phrases import roster_line, safe, source_label


def padded(text: Column, width: Column | int) -> Column:
    """The text with blanks behind it up to a width; longer texts stay whole."""
    wide = F.lit(width) if isinstance(width, int) else width
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(wide - F.char_length(text), F.lit(0)).cast("int")))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def alias_lines(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """player_id and its aliases on one line, in order of their ids: one of each key, none that is the player's own name. Players without any have no row."""
    own = players.select("player_id", name_key(F.col("name")).alias("own"))
    keyed = aliases.withColumn("key", name_key(F.col("alias"))).groupBy("player_id", "key").agg(F.min(F.struct("alias_id", "alias")).alias("m"))
    kept = keyed.join(own, "player_id").where("key <> own")
    lines = kept.groupBy("player_id").agg(F.array_sort(F.collect_list("m")).alias("l"))
    return lines.select("player_id", F.array_join(F.transform("l", lambda x: safe(x["alias"])), ", ").alias("text"))


def ambiguity_lines(found: DataFrame, by: str) -> DataFrame:
    """``by`` and one line on its ambiguous identities (place, incoming, context, candidates: array of names), in order of their places."""
    facts = F.concat(F.lit('"'), "incoming", F.lit('" ('), "context", F.lit(") — near: "), F.array_join("candidates", ", "))
    lines = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", facts.alias("f")))).alias("l"))
    n = F.size("l")
    several = F.concat(n.cast("string"), F.lit(" ambiguous identities — "), F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["f"])), "; "))
    return lines.select(by, F.when(n == 1, F.concat(F.lit("ambiguous identity "), F.get("l", F.lit(0))["f"])).otherwise(several).alias("text"))


def lineup_texts(predicted: DataFrame, teams: DataFrame, players: DataFrame, status: DataFrame, unplaced: DataFrame, ranks: DataFrame, sizes: DataFrame) -> DataFrame:
    """team_id and the text of its predicted lineup.

    ``predicted``: team_id, slot, place, discipline, player_ids, basis, support, confidence; ``teams``: team_id, team_name; ``players``: player_id,
    name; ``status`` as ``plan_status`` gives it with event_name; ``unplaced``: team_id, player_id, court_matches; ``ranks``: team_id,
    player_id, source, value; ``sizes``: team_id, registered, season. Names are made safe to print.
    """
    names = players.select("player_id", safe(F.col("name")).alias("name"))
    seats = predicted.select("team_id", "slot", "place", "discipline", "basis", "support", "confidence", F.posexplode_outer("player_ids").alias("seat", "player_id")).join(names, "player_id", "left")
    widths = seats.groupBy("team_id").agg(F.greatest(F.coalesce(F.max(F.char_length("name")), F.lit(1)), F.lit(1)).alias("width"))
    noun = F.when(F.col("discipline") == "singles", counted(F.col("support"), "singles match", "singles matches")).otherwise(counted(F.col("support"), "match together", "matches together"))
    evidence = F.concat(F.lit("conf: "), padded(F.col("confidence"), 6), F.lit("  "), F.when(F.col("basis") == "rating", "placed by rating — no shared history").otherwise(noun))
    first = F.col("seat") == 0
    line = F.concat(F.lit("  "), F.when(first, padded(F.col("slot"), 4)).otherwise("    "), F.lit(" "), padded(F.col("name"), F.col("width")), F.when(first, F.concat(F.lit("  "), evidence)).otherwise(""))
    empty = F.concat(F.lit("  "), padded(F.col("slot"), 4), F.lit(" "), padded(F.lit("(unfilled — roster exhausted)"), F.col("width")))
    lines = seats.join(widths, "team_id").select("team_id", F.struct("place", "slot", F.coalesce("seat", F.lit(0)).alias("seat"), F.when(F.col("player_id").isNull(), empty).otherwise(F.rtrim(line)).alias("line")).alias("l"))
    body = lines.groupBy("team_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))
    courts = predicted.groupBy("team_id").agg(F.count("*").alias("courts"))

    def listed(rows: DataFrame, name: str, text: Column) -> DataFrame:
        return rows.join(names, "player_id").groupBy("team_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("player_id", text.alias("t")))), lambda x: x["t"]), ", ").alias(name))

    left = listed(unplaced, "left_out", F.concat("name", F.lit(" ("), counted(F.col("court_matches"), "court match", "court matches"), F.lit(")")))
    unrated = listed(ranks.where("value IS NULL AND source IS NOT NULL"), "unrated", F.col("name"))
    sources = ranks.groupBy("team_id").agg(F.max("source").alias("source"))
    t = status.where("status = 'predicted'").join(teams.select("team_id", safe(F.col("team_name")).alias("team_name")), "team_id")
    for more in (body, courts, left, unrated, sources, sizes):
        t = t.join(more, "team_id", "left")
    event = F.when(F.col("slot_source") == "event-format", F.col("event_name"))
    head = F.concat(F.lit("PREDICTED LINEUP — "), "team_name", F.lit("\n  This is a guess, not a lineup card. Based on "), counted(F.col("observed"), "observed court match", "observed court matches"), F.lit(" across a roster of "), F.col("roster_size").cast("string"), F.lit(".\n"))
    ratings = F.when(F.col("source").isNull(), "  ratings: none on file — every tie fell through to a stable ordering, not to strength").otherwise(
        F.concat(F.lit("  ratings: ranked within "), source_label(F.col("source")), F.coalesce(F.concat(F.lit("; unrated: "), "unrated"), F.lit("")))
    )
    slots = F.concat(F.lit("  courts: "), F.col("courts").cast("string"), F.when(event.isNull(), ", from this team's observed match history (not the event format)").otherwise(F.concat(F.lit(', from the format of event "'), safe(event), F.lit('"'))))
    roster = F.concat(F.lit("  roster: "), roster_line(F.col("roster_source"), event, F.coalesce("registered", F.lit(0)), F.coalesce("season", F.lit(0))))
    out = F.when(F.col("excluded_other_team") > 0, F.concat(F.lit("  excluded: "), counted(F.col("excluded_other_team"), "court match", "court matches"), F.lit(" these players played for other teams")))
    return t.select("team_id", F.concat_ws("\n", head, "body", F.lit(""), F.concat(F.lit("  not placed: "), "left_out"), ratings, slots, roster, out).alias("text"))
