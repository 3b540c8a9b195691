"""League scope: which matches count as evidence, with a full account of what was set aside.

Contexts and prefixes are compared under NFKC and lower case. Where all contexts are known to be ASCII,
``fold=F.lower`` says the same without leaving the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.keys import nfkc


def folded(text: Column) -> Column:
    return F.lower(nfkc(text))


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def parse_scope(text: str) -> tuple[str, list[str]]:
    """``exclude:Mixed,Tri`` or ``only:Adult``: the mode up to the first colon, then distinct prefixes."""
    mode, colon, rest = text.partition(":")
    prefixes = [p.strip() for p in rest.split(",")]
    if mode not in ("exclude", "only") or not colon or not all(prefixes) or len({_fold(p) for p in prefixes}) < len(prefixes):
        raise ValueError(f"not a league scope: {text!r}")
    return mode, prefixes


def retains(context: Column, mode: str, prefixes: list[str], fold=folded) -> Column:
    """Whether a match of this context stays. A null context stays under both modes."""
    hit, text = F.lit(False), fold(context)
    for p in prefixes:
        hit = hit | text.startswith(_fold(p))
    return F.coalesce(hit if mode == "only" else ~hit, F.lit(True))


def scope_summary(rows: DataFrame, mode: str, prefixes: list[str], by: str = "player_id", fold=folded) -> DataFrame:
    keep = retains(F.col("league_context"), mode, prefixes, fold)
    return rows.groupBy(by).agg(
        F.count("*").alias("considered"), F.count(F.when(keep, 1)).alias("retained"), F.count(F.when(~keep, 1)).alias("excluded"), F.count(F.when(F.col("league_context").isNull(), 1)).alias("unclassified")
    )


def retained_leagues(rows: DataFrame, mode: str, prefixes: list[str], fold=folded) -> DataFrame:
    """Matches of each retained context; the null context has a row of its own."""
    return rows.where(retains(F.col("league_context"), mode, prefixes, fold)).groupBy("league_context").agg(F.count("*").alias("matches"))
