"""Scorecard and roster payloads: JSON lines with a fixed schema and cross-field rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COURT = "slot: string, discipline: string, homePlayers: array<string>, visitingPlayers: array<string>, winnerSide: string, score: string, defaulted: boolean"
SCORECARD = f"event string, playedOn string, homeTeam string, visitingTeam string, scheduledTime string, site string, sourceImage string, courts array<struct<{COURT}>>"
ROSTER = "team string, event string, players array<string>"


def scorecards(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The payload's fields, one row for each court, with ``refusals``: every broken rule of the payload and the court."""
    from rallyframe.functions.keys import is_iso_day

    p = payloads.select("*", F.from_json(column, SCORECARD, {"mode": "PERMISSIVE"}).alias("p"))
    whole = [(F.col("p").isNull() | F.col("p.courts").isNull() | (F.size("p.courts") < 1), "no courts"), (~is_iso_day(F.col("p.playedOn")), "not a day"), (F.coalesce("p.homeTeam", F.lit("")) == "", "no home team"), (F.coalesce("p.visitingTeam", F.lit("")) == "", "no visiting team")]
    slots = F.transform("p.courts", lambda c: F.upper(F.trim(c.slot)))
    whole.append((F.size(F.array_distinct(slots)) < F.size(slots), "slot given twice"))
    p = p.withColumn("w", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in whole]))).select("*", F.posexplode_outer("p.courts").alias("place", "c"))
    each = F.when(F.coalesce("c.defaulted", F.lit(False)), 0).when(F.col("c.discipline") == "singles", 1).otherwise(2)
    court = [
        (~F.coalesce(F.col("c.discipline").isin("singles", "doubles"), F.lit(False)), "unknown discipline"), (F.coalesce(F.trim("c.slot"), F.lit("")) == "", "no slot"),
        (F.size("c.homePlayers") != each, "wrong number of home players"), (F.size("c.visitingPlayers") != each, "wrong number of visiting players"), (~F.col("c.winnerSide").isin("home", "visiting"), "unknown winner"),
    ]
    broken = F.when(F.col("c").isNotNull(), F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in court]))).otherwise(F.array())
    return p.select(*payloads.columns, "p.event", "p.playedOn", "p.homeTeam", "p.visitingTeam", "place", F.upper(F.trim("c.slot")).alias("slot"), "c.discipline", "c.homePlayers", "c.visitingPlayers", "c.winnerSide", "c.score", F.concat("w", broken).alias("refusals"))


def rosters(payloads: DataFrame, column: str = "payload") -> DataFrame:
    p = payloads.select("*", F.from_json(column, ROSTER).alias("p"))
    bad = F.coalesce("p.team", F.lit("")) == ""
    empty = F.col("p.players").isNull() | (F.size("p.players") < 1)
    return p.select(*payloads.columns, "p.team", "p.event", "p.players", F.when(bad, "no team").when(empty, "no players").alias("refusal"))


def images(spark, path: str, most_bytes: int = 25 << 20) -> DataFrame:
    """Scorecard images of a supported kind (by name and first bytes) and size; files of other names or sizes are not opened."""
    head = F.hex(F.substring("content", 1, 8))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}").load(path).where(F.col("length") <= most_bytes)
    return files.where(head.startswith("FFD8FF") | (head == "89504E470D0A1A0A")).select("path", "length", "content")
