"""Lineups: what Spark can aggregate is aggregated first; the short sequential choice runs for each team.

What reaches a group is bounded by its courts, not by its roster. A choice that takes t seats in all
(one for each singles court, two for each other one) can only ever take the first 2 t players by rank and, of pairs
that ask for courts in the same order, the first t (t + 1) + 1 of those that are among the first t + 1 of
both their players: a pair behind them is never the best free one, since t seats cannot block all before it.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.sources.store import written

PREDICTED = "team_id int, slot string, discipline string, player_ids array<long>, basis string, support long"


def observed_slots(own: DataFrame) -> DataFrame:
    """team_id, slot, discipline and place of the slots that a team's own matches were played at: the most frequent discipline (ties by name); singles, doubles, others, then number (none: last), then name."""
    courts = own.select("team_id", "match_id", "slot", "discipline").distinct().groupBy("team_id", "slot", "discipline").agg(F.count("*").alias("n"))
    best = courts.groupBy("team_id", "slot").agg(F.min(F.struct((-F.col("n")).alias("k"), "discipline")).alias("m")).select("team_id", "slot", F.col("m.discipline").alias("discipline"))
    kind = F.when(F.col("discipline") == "singles", 0).when(F.col("discipline") == "doubles", 1).otherwise(2)
    number = F.coalesce(F.regexp_extract("slot", r"([0-9]+)$", 1).try_cast("long"), F.lit(1 << 40))
    order = Window.partitionBy("team_id").orderBy(kind, number, "slot")
    return best.withColumn("place", F.row_number().over(order).cast("long"))


def own_singles(own: DataFrame) -> DataFrame:
    return own.where("discipline = 'singles'").groupBy("team_id", "player_id").agg(F.count("*").alias("matches"))


def own_pairs(own: DataFrame) -> DataFrame:
    """team_id, low_id, high_id, slot, matches: roster players of one team on one side of a court that is not singles."""
    a = own.where("discipline <> 'singles'").select("team_id", "match_id", "side", "slot", F.col("player_id").alias("low_id"))
    b = a.select("team_id", "match_id", "side", F.col("low_id").alias("high_id"))
    return a.join(b, ["team_id", "match_id", "side"]).where("low_id < high_id").groupBy("team_id", "low_id", "high_id", "slot").agg(F.count("*").alias("matches"))


def unplaced(predicted: DataFrame, roster: DataFrame, own: DataFrame) -> DataFrame:
    """team_id, player_id and court_matches (of the team's own) of roster players whom no court of a predicted team takes."""
    placed = predicted.select("team_id", F.explode("player_ids").alias("player_id"))
    played = own.groupBy("team_id", "player_id").agg(F.count("*").alias("court_matches"))
    rest = roster.join(predicted.select("team_id").distinct(), "team_id", "leftsemi").join(placed, ["team_id", "player_id"], "leftanti")
    return rest.join(played, ["team_id", "player_id"], "left").select("team_id", "player_id", F.coalesce("court_matches", F.lit(0)).alias("court_matches"))


def plan_status(entries: DataFrame, roster: DataFrame, own: DataFrame, all_rows: DataFrame, formats: DataFrame) -> DataFrame:
    """For each entry (team_id, event_id) whether a lineup can be predicted, and what it rests on.

    ``own``: rows of roster players in their team's matches; ``all_rows``: all their rows; ``formats``: event_id,
    courts (their number; null without a format). Refusals in order: no roster, an empty format, no history.
    """
    size = roster.groupBy("team_id").agg(F.count("*").alias("roster_size"), F.first("scope").alias("roster_source"))
    seen = own.groupBy("team_id").agg(F.count_distinct("match_id").alias("observed"))
    every = all_rows.select("team_id", "match_id").distinct().groupBy("team_id").agg(F.count("*").alias("all"))
    e = entries.join(size, "team_id", "left").join(seen, "team_id", "left").join(every, "team_id", "left").join(formats, "event_id", "left")
    n, k = F.coalesce("roster_size", F.lit(0)), F.coalesce("observed", F.lit(0))
    status = F.when(n == 0, "no roster").when(F.col("courts") == 0, "empty format").when(k == 0, "no history").otherwise("predicted")
    return e.select(
        "team_id", "event_id", status.alias("status"), n.alias("roster_size"), "roster_source", F.when(F.col("courts").isNull(), "observed").otherwise("event-format").alias("slot_source"), k.alias("observed"), (F.coalesce("all", F.lit(0)) - k).alias("excluded_other_team")
    )


def seats(courts: DataFrame, by: str) -> int:
    """The most seats that any group's courts have."""
    n = F.when(F.col("discipline") == "singles", 1).otherwise(2)
    return courts.groupBy(by).agg(F.sum(n).alias("n")).agg(F.max("n")).first()[0] or 0


def first_pairs(pairs: DataFrame, by: list[str], order: list[str], t: int) -> DataFrame:
    """Of the pairs (low_id, high_id) of each group those that a choice of t seats by ``order`` can reach."""
    rest = [c for c in pairs.columns if c not in by]
    ends = pairs.withColumn("__v", F.explode(F.array("low_id", "high_id")))
    best = ends.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__v").orderBy(*order, "low_id", "high_id"))).where(F.col("__k") <= t + 1)
    both = best.groupBy(*by, *rest).agg(F.count("*").alias("__n")).where("__n = 2").drop("__n")
    ranked = both.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "low_id", "high_id")))
    return ranked.where(F.col("__k") <= t * (t + 1) + 1).drop("__k")


def _reachable(slots: DataFrame, ranks: DataFrame, singles: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranks, singles counts and pairs that a prediction can use."""
    t = seats(slots, "team_id")
    queue = ranks.join(singles, ["team_id", "player_id"], "left").withColumn("__turn", F.row_number().over(Window.partitionBy("team_id").orderBy(F.coalesce("matches", F.lit(0)).desc(), "rank", "player_id")))
    queue = queue.where(F.col("__turn") <= t)
    top = ranks.withColumn("__k", F.row_number().over(Window.partitionBy("team_id").orderBy("rank", "player_id"))).where(F.col("__k") <= 2 * t)
    # A pair's class: the courts that it has stood on, in the order in which it asks for them.
    places = slots.where("discipline <> 'singles'").select("team_id", "slot", "place")
    asks = pairs.join(places, ["team_id", "slot"], "left").groupBy("team_id", "low_id", "high_id").agg(
        F.sum("matches").alias("total"), F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct((-F.col("matches")).alias("m"), "place", "slot")))).alias("asked")
    )
    low, high = (ranks.select("team_id", F.col("player_id").alias(f"{x}_id"), F.col("rank").alias(f"{x}_rank")) for x in ("low", "high"))
    asks = asks.where("total >= 2").join(low, ["team_id", "low_id"]).join(high, ["team_id", "high_id"])
    asks = asks.select("team_id", "low_id", "high_id", F.array_join(F.transform("asked", lambda a: a["slot"]), "\n").alias("__asked"), (F.col("low_rank") + F.col("high_rank")).alias("__both"), (-F.col("total")).alias("__less"))
    asks = written(asks, "asks")
    kept = first_pairs(asks, ["team_id", "__asked"], ["__both", "__less"], t).select("team_id", "low_id", "high_id")
    kept = written(kept, "kept")
    people = queue.select("team_id", "player_id").union(top.select("team_id", "player_id")).union(kept.select("team_id", "low_id")).union(kept.select("team_id", "high_id")).distinct()
    return ranks.join(people, ["team_id", "player_id"], "leftsemi"), singles.join(people, ["team_id", "player_id"], "leftsemi"), pairs.join(kept, ["team_id", "low_id", "high_id"], "leftsemi")


def predicted_lineup(slots: DataFrame, ranks: DataFrame, singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Who probably plays where.

    ``slots``: team_id, slot, discipline, place. ``ranks``: team_id, player_id, rank. ``singles``: team_id,
    player_id, matches. ``pairs``: team_id, low_id, high_id, slot, matches.

    Singles slots, in order, take the free player with most singles matches (ties: rank, id). Then in
    rounds every free pair with two matches or more asks for its most frequent open doubles slot; of
    the pairs that ask for one slot the strongest stands (best combined rank, then most matches, then
    ids); of those the one with most matches is placed (ties: the stronger, then slot order). Pairs
    without an open slot of their own take the first open one. What is left goes by rank: a court may
    stay short or empty, and a player is on one court at most. Courts that are not singles are taken
    as doubles.
    """
    ranks, singles, pairs = _reachable(slots, ranks, singles, pairs)
    rows = (
        slots.select("team_id", F.lit("slot").alias("kind"), "slot", "discipline", F.col("place").cast("long").alias("n"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
        .union(ranks.select("team_id", F.lit("rank"), F.lit(None), F.lit(None), F.col("rank").cast("long"), F.col("player_id"), F.lit(None)))
        .union(singles.select("team_id", F.lit("single"), F.lit(None), F.lit(None), "matches", F.col("player_id"), F.lit(None)))
        .union(pairs.select("team_id", F.lit("pair"), "slot", F.lit(None), "matches", "low_id", "high_id"))
    )
    return rows.groupBy("team_id").applyInPandas(_predict, PREDICTED)


def _predict(team: pd.DataFrame) -> pd.DataFrame:
    of = {k: team[team["kind"] == k] for k in ("slot", "rank", "single", "pair")}
    courts = [(r.slot, r.discipline) for r in of["slot"].sort_values(["n", "slot"]).itertuples()]
    rank = {int(r.a): int(r.n) for r in of["rank"].itertuples()}
    played = {int(r.a): int(r.n) for r in of["single"].itertuples()}
    history: dict[tuple[int, int], dict[str, int]] = {}
    for r in of["pair"].itertuples():
        if int(r.a) in rank and int(r.b) in rank:
            history.setdefault((int(r.a), int(r.b)), {})[r.slot] = int(r.n)
    history = {p: s for p, s in history.items() if sum(s.values()) >= 2}
    free, placed = set(rank), {}
    for slot, kind in courts:
        if kind == "singles" and free:
            p = min(free, key=lambda i: (-played.get(i, 0), rank[i], i))
            free.discard(p)
            placed[slot] = ([p], "history" if played.get(p) else "rating", played.get(p, 0))
    order = {slot: k for k, (slot, kind) in enumerate(courts) if kind != "singles"}
    total = {p: sum(s.values()) for p, s in history.items()}
    strength = {p: (rank[p[0]] + rank[p[1]], -total[p], p) for p in history}

    def seat(slot: str, pair: tuple[int, int]) -> None:
        free.difference_update(pair)
        placed[slot] = (list(pair), "history", total[pair])

    while True:
        asked: dict[str, tuple[int, int]] = {}
        for pair in sorted((p for p in history if free.issuperset(p)), key=strength.get):
            mine = [s for s in history[pair] if s in order and s not in placed]
            if mine:
                asked.setdefault(min(mine, key=lambda x: (-history[pair][x], order[x])), pair)
        if not asked:
            break
        slot = min(asked, key=lambda x: (-total[asked[x]], strength[asked[x]], order[x]))
        seat(slot, asked[slot])
    for pair in sorted(history, key=strength.get):
        left = [s for s in order if s not in placed]
        if left and free.issuperset(pair):
            seat(left[0], pair)
    for slot in order:
        if slot not in placed:
            rest = sorted(free, key=lambda i: (rank[i], i))[:2]
            free.difference_update(rest)
            placed[slot] = (rest, "rating", 0)
    team_id = int(team["team_id"].iloc[0])
    return pd.DataFrame([(team_id, s, k, *placed.get(s, ([], "rating", 0))) for s, k in courts], columns=["team_id", "slot", "discipline", "player_ids", "basis", "support"])


SCENARIOS = "team_id int, event_id int, day date, strategies string, slot string, discipline string, player_ids array<long>, filled boolean, strength double, shared_matches long, doubles_only_override boolean, sitting array<long>, unfilled_seats int"
DAY = ["team_id", "event_id", "day"]


def day_ledger(grid: DataFrame, eligible: DataFrame, courts: DataFrame) -> DataFrame:
    """For each team and day of an event: answers by kind, how many are eligible (for singles; rated), the bodies its courts need and the shortfall."""
    status = F.col("status")
    counts = grid.groupBy(*DAY).agg(*[F.count(F.when(status == x, 1)).alias(x) for x in ("available", "unavailable", "uncertain")], F.count(F.when(status.isNull(), 1)).alias("unrecorded"))
    able = eligible.groupBy(*DAY).agg(F.count(F.when(~F.col("doubles_only"), 1)).alias("singles_eligible"), F.count("strength").alias("rated_eligible"))
    needs = courts.groupBy("event_id").agg(F.sum(F.when(F.col("discipline") == "singles", 1).otherwise(2)).alias("bodies_needed"))
    out = counts.join(able, DAY, "left").join(needs, "event_id").fillna(0, ["singles_eligible", "rated_eligible"])
    return out.select(*DAY, "available", "unavailable", "uncertain", "unrecorded", "singles_eligible", "rated_eligible", "bodies_needed", F.greatest(F.col("bodies_needed") - F.col("available"), F.lit(0)).alias("shortfall"))


def day_scenarios(eligible: DataFrame, pairs: DataFrame, courts: DataFrame) -> DataFrame:
    """Three ways to field a team on a day of an event, from its available players only; equal ways are merged.

    ``eligible``: team_id, event_id, day, player_id, strength (null: unrated), singles (matches), doubles_only. ``pairs``:
    team_id, low_id, high_id, matches. ``courts``: event_id, slot, discipline, place. Singles go to the
    strongest (history first: to those with most singles matches); who plays doubles only is taken
    there last. Doubles: strength first takes pairs in order; history first the pair with most matches
    together, or the strongest two where none has any; balanced, of all pairings of the strength-first
    field, the first with the least spread of pair sums. Of groups the one with more rated players
    comes first, then the stronger (within 1e-9), then by ids. A doubles court that cannot be filled
    stays empty. ``sitting``: the available players of whom no court is made.
    """
    none = {k: F.lit(None).cast(t) for k, t in (("a", "long"), ("b", "long"), ("strength", "double"), ("n", "long"), ("flag", "boolean"), ("slot", "string"), ("discipline", "string"))}

    def rows(df: DataFrame, kind: str, **given) -> DataFrame:
        return df.select(*DAY, F.lit(kind).alias("kind"), *[given.get(k, v).alias(k) for k, v in none.items()])

    days = eligible.select(*DAY).distinct()
    everyone = eligible.groupBy(*DAY).agg(F.array_sort(F.collect_set("player_id")).alias("__all"))
    t = seats(courts, "event_id")
    by_rank = ["__unrated", "__weaker", "player_id"]
    ranked = eligible.withColumn("__unrated", F.col("strength").isNull()).withColumn("__weaker", -F.coalesce("strength", F.lit(0.0))).withColumn("__only", F.coalesce("doubles_only", F.lit(False)))
    keep = None
    for order, most in ((by_rank, 2 * t), (["__only", *by_rank], t), (["__only", F.col("singles").desc(), *by_rank], t)):
        first = ranked.withColumn("__k", F.row_number().over(Window.partitionBy(*DAY).orderBy(*order))).where(F.col("__k") <= most).select(*DAY, "player_id")
        keep = first if keep is None else keep.union(first)
    able = {x: ranked.select(*DAY, F.col("player_id").alias(f"{x}_id"), F.col("__unrated").cast("int").alias(f"{x}_u"), F.col("__weaker").alias(f"{x}_w")) for x in ("low", "high")}
    met = pairs.where("matches > 0").join(able["low"], ["team_id", "low_id"]).join(able["high"], [*DAY, "high_id"])
    met = met.select(*DAY, "low_id", "high_id", "matches", (-F.col("matches")).alias("__less"), (F.col("low_u") + F.col("high_u")).alias("__u"), F.round(F.col("low_w") + F.col("high_w"), 9).alias("__w"))
    met = first_pairs(met, DAY, ["__less", "__u", "__w"], t)
    met = met.select(*DAY, F.explode(F.array("low_id", "high_id")).alias("player_id"))
    keep = written(keep.union(met).distinct(), "reachable")
    eligible = eligible.join(keep, [*DAY, "player_id"], "leftsemi")
    # What two kept players have in common is shown, whoever pairs them.
    for end in ("low_id", "high_id"):
        mine = keep.withColumnRenamed("player_id", end)
        pairs = pairs.join(mine, ["team_id", end] if end == "low_id" else [*DAY, end])
    people = rows(eligible, "player", a=F.col("player_id"), strength=F.col("strength"), n=F.col("singles").cast("long"), flag=F.col("doubles_only"))
    known = rows(pairs, "pair", a=F.col("low_id"), b=F.col("high_id"), n=F.col("matches").cast("long"))
    places = rows(courts.join(days, "event_id"), "court", slot=F.col("slot"), discipline=F.col("discipline"), n=F.col("place").cast("long"))
    chosen = people.union(known).union(places).groupBy(*DAY).applyInPandas(_scenarios, SCENARIOS)
    taken = F.flatten(F.collect_list("player_ids").over(Window.partitionBy(*DAY, "strategies")))
    chosen = chosen.withColumn("__taken", taken).join(everyone, DAY)
    return chosen.withColumn("sitting", F.array_except("__all", "__taken")).drop("__taken", "__all").select([c.split()[0] for c in SCENARIOS.split(", ")])


def pairings(players: list[int]):
    """All ways to split an even number of players into pairs, one at a time."""
    if not players:
        yield []
        return
    first, rest = players[0], players[1:]
    for k, other in enumerate(rest):
        for more in pairings(rest[:k] + rest[k + 1 :]):
            yield [(first, other), *more]


def _scenarios(group: pd.DataFrame) -> pd.DataFrame:
    people, known, places = (group[group["kind"] == k] for k in ("player", "pair", "court"))
    courts = [(r.slot, r.discipline) for r in places.sort_values(["n", "slot"]).itertuples()]
    singles, doubles = [s for s, k in courts if k == "singles"], [s for s, k in courts if k != "singles"]
    strength = {int(r.a): None if pd.isna(r.strength) else float(r.strength) for r in people.itertuples()}
    alone = {int(r.a): int(r.n or 0) for r in people.itertuples()}
    only = {int(r.a) for r in people.itertuples() if r.flag}
    together = {(int(r.a), int(r.b)): int(r.n) for r in known.itertuples() if int(r.a) in strength and int(r.b) in strength}

    def single_key(p: int) -> tuple:
        return (strength[p] is None, -(strength[p] or 0.0), p)

    def group_key(pair) -> tuple:  # sums are rounded, so that they compare within 1e-9
        return (sum(strength[p] is None for p in pair), round(-sum(strength[p] or 0.0 for p in pair), 9), tuple(sorted(pair)))

    ranked = sorted(strength, key=single_key)
    by_rating = sorted(ranked, key=lambda p: p in only)[: len(singles)]
    by_history = sorted(ranked, key=lambda p: (p in only, -alone[p], single_key(p)))[: len(singles)]
    field = [p for p in ranked if p not in by_rating]
    strong = [tuple(field[i : i + 2]) for i in range(0, min(len(field) - 1, 2 * len(doubles)), 2)]
    left, kept = [p for p in ranked if p not in by_history], []
    while len(kept) < len(doubles) and len(left) >= 2:
        best = min(combinations(sorted(left), 2), key=lambda p: (-together.get(p, 0), group_key(p)))
        best = best if together.get(best) else tuple(left[:2])
        kept.append(best)
        left = [p for p in left if p not in best]
    even, least = [], None
    for way in pairings(field[: 2 * len(strong)]):
        sums = [sum(strength[p] or 0.0 for p in pair) for pair in way]
        spread = max(sums, default=0) - min(sums, default=0)
        if least is None or spread < least - 1e-9:
            even, least = way, spread
    ways: dict[tuple, list[str]] = {}
    for name, solo, pairs in (("strength-first", by_rating, strong), ("history-first", by_history, kept), ("balanced", by_rating, sorted(even, key=group_key))):
        seats = dict(zip(singles, ([p] for p in solo))) | dict(zip(doubles, (sorted(p, key=single_key) for p in pairs)))
        ways.setdefault(tuple(tuple(seats.get(s, [])) for s, _ in courts), []).append(name)
    out, key = [], [group[c].iloc[0] for c in DAY]
    for taken, names in ways.items():
        sitting = sorted(set(strength) - {p for who in taken for p in who})
        empty = sum((1 if kind == "singles" else 2) - len(who) for (_, kind), who in zip(courts, taken))
        for (slot, kind), who in zip(courts, taken):
            rated, alone_there = [strength[p] for p in who if strength[p] is not None], kind == "singles"
            shared = together.get(tuple(sorted(who)), 0) if len(who) == 2 else None
            out.append((*key, ",".join(names), slot, kind, list(who), len(who) == (1 if alone_there else 2), sum(rated) if rated else None, shared, alone_there and bool(only.intersection(who)), sitting, empty))
    frame = pd.DataFrame(out, columns=[*DAY, "strategies", "slot", "discipline", "player_ids", "filled", "strength", "shared_matches", "doubles_only_override", "sitting", "unfilled_seats"])
    return frame.astype({"shared_matches": "Int64"})
