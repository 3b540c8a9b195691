"""Keys for names, times, sites and slugs, and a join on bounded edit distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that render as nothing: controls, format characters, and (fixed values) the grapheme
# joiner, fillers, vowel inherent signs, variation selectors and other ignorable code points.
INVISIBLE = "\\p{Cc}\\p{Cf}\\u034F\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F\\u3164\\uFE00-\\uFE0F\\uFFA0\\x{E0100}-\\x{E01EF}"
# Those of scripts whose invisible characters carry meaning stay, and so does what renders as a blank.
IGNORED = f"[{INVISIBLE}&&[\\p{{IsCommon}}\\p{{IsInherited}}\\p{{IsLatin}}]&&[^\\p{{IsWhite_Space}}]]"
NULL_KEY = "null"  # no text's key: those have a tag with a colon


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def name_key(name: Column) -> Column:
    """Without invisible characters, trimmed, NFKC, lower case, in this order."""
    bare = F.regexp_replace(F.regexp_replace(name, IGNORED, ""), r"(?U)^\s+|\s+$", "")
    return F.lower(nfkc(bare))


def ascii_name_key(name: Column) -> Column:
    """The same for names known to be ASCII, JVM-side throughout."""
    return F.lower(F.trim(name))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def loose_key(text: Column) -> Column:
    """``raw:`` and the ASCII letters and digits of the lower-cased text; without any, ``lit:`` and the text with single blanks."""
    low = F.lower(text)
    bare = F.regexp_replace(low, "[^a-z0-9]", "")
    return F.when(bare != "", F.concat(F.lit("raw:"), bare)).otherwise(F.concat(F.lit("lit:"), squeezed(low)))


def squeezed(text: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def time_key(text: Column) -> Column:
    """``clock:HH:MM`` of a 12-hour time, blanks allowed about its parts; any other text's loose key; null has a key of its own."""
    parts = F.split(squeezed(F.lower(text)), ":")
    hour, rest = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    half = F.ltrim(F.substring(rest, 3, 100))
    shaped = (F.size(parts) == 2) & hour.rlike("^[0-9]{1,2}$") & rest.rlike("^[0-9]{2}") & half.isin("am", "am.", "a.m", "a.m.", "pm", "pm.", "p.m", "p.m.")
    h24 = F.pmod(hour.try_cast("int"), F.lit(12)) + F.when(half.startswith("p"), 12).otherwise(0)
    clock = F.concat(F.lit("clock:"), F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), F.substring(rest, 1, 2))
    return F.when(text.isNull(), NULL_KEY).when(shaped, clock).otherwise(loose_key(text))


def site_key(text: Column) -> Column:
    """A site's loose key: case and punctuation do not count; null has a key of its own."""
    return F.when(text.isNull(), NULL_KEY).otherwise(loose_key(text))


def is_iso_day(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_season(text: Column) -> Column:
    """A year of four digits that does not begin with zero, and nothing else."""
    return F.coalesce((F.char_length(text) == 4) & (F.translate(text, "0123456789", "") == "") & ~text.startswith("0"), F.lit(False))


def twelve_months_before(day: Column) -> Column:
    return F.add_months(day, -12)


def fuzzy_neighbours(left: DataFrame, right: DataFrame, key: str = "key", radius: int = 2) -> DataFrame:
    """Distinct pairs of keys (``key``, ``other_key``) that are 1 to ``radius`` edits apart, with the edits.

    A key within d edits keeps one of d + 1 pieces whole, at a place moved by at most d: keys are
    joined on such pieces (an equi-join), and the edit distance only confirms. Keys too short to have
    a piece of each kind are few, since keys are distinct, and meet by length.
    """
    pieces, k, other = radius + 1, F.col(key), F.col(f"other_{key}")

    def piece(length: Column, i: int) -> tuple[Column, Column]:
        at, end = F.floor(length * i / pieces), F.floor(length * (i + 1) / pieces)
        return at.cast("int"), (end - at).cast("int")

    n = F.char_length(k)
    own = []
    for i in range(pieces):
        at, size = piece(n, i)
        own.append(F.struct(F.lit(i).alias("i"), n.alias("n"), F.substring(k, at + 1, size).alias("s")))
    a = left.select(k).where(k.isNotNull()).distinct().select(k, F.explode(F.array_distinct(F.array(*own))).alias("__p"))
    b = right.select(k.alias(f"other_{key}")).where(other.isNotNull()).distinct()
    # Only lengths that occur on the left make pieces on the right.
    m = F.char_length(other)
    lengths = a.select(F.col("__p.n").alias("n")).distinct()
    b = b.select(other, F.explode(F.sequence(F.greatest(m - radius, F.lit(0)), m + radius)).alias("n")).join(lengths, "n")
    wanted = []
    for i in range(pieces):
        at, size = piece(F.col("n"), i)
        for shift in range(-radius, radius + 1):
            # a piece that moves by more than the difference in length allows needs more edits than there are
            fits = (at + shift >= 0) & (at + shift + size <= m) & (abs(shift) + F.abs(m - F.col("n") - shift) <= radius)
            wanted.append(F.when(fits, F.struct(F.lit(i).alias("i"), F.col("n").alias("n"), F.substring(other, at + shift + 1, size).alias("s"))))
    b = b.select(other, F.explode(F.array_distinct(F.filter(F.array(*wanted), lambda x: x.isNotNull()))).alias("__p"))
    return a.join(b, "__p").drop("__p").distinct().withColumn("edits", F.levenshtein(k, other).cast("long")).where(F.col("edits").between(1, radius))
