"""Constraints found in question texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from halocast import rules
from halocast.functions.geo import _col

# fixed values: coordinate patterns; the base form allows a blank before N or S
POINT_PATTERNS = {
    "base": r"(\d+\.?\d*)[°]?\s*([NS])\s*,?\s*(\d+\.?\d*)[°]?\s*([EW])",
    "enhanced": r"(\d+\.?\d*)[°]?([NS])\s*,?\s*(\d+\.?\d*)[°]?([EW])",
}


def region_box(low, ruleset: str = "base", match: str = "longest") -> Column:
    """Struct of the named region found in the lower-cased text, or null.

    ``first`` takes the first region in rule order, ``longest`` the longest
    matching name, so 'north atlantic' beats 'atlantic'.
    """
    rows = rules.region_rows(ruleset)
    if match == "longest":
        rows.sort(key=lambda r: (-len(r[1]), r[0]))
    # a chain of tests in order of preference stops at the first name found
    return F.coalesce(*[F.when(F.contains(_col(low), F.lit(name)), F.struct(
        F.lit(name).alias("name"), F.lit(a).alias("lat_min"), F.lit(b).alias("lat_max"),
        F.lit(c).alias("lon_min"), F.lit(d).alias("lon_max"))) for _, name, a, b, c, d in rows])


def has_region_word(low, ruleset: str = "enhanced") -> Column:
    names = [n for n, *_ in rules.REGIONS[ruleset]]
    return reduce(lambda a, b: a | b, [F.contains(_col(low), F.lit(n)) for n in names])


def point_box(text, ruleset: str = "base") -> Column:
    """Struct box of 5 degrees around the first coordinate pair, or null."""
    pattern, text = POINT_PATTERNS[ruleset], _col(text)
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 5)]
    lat = part[0].try_cast("double") * F.when(part[1] == "N", 1.0).otherwise(-1.0)
    lon = part[2].try_cast("double") * F.when(part[3] == "E", 1.0).otherwise(-1.0)
    half = rules.POINT_BOX_DEGREES
    return F.when(part[1] != "", F.struct(
        F.lit("point").alias("name"),
        (lat - half).alias("lat_min"), (lat + half).alias("lat_max"),
        (lon - half).alias("lon_min"), (lon + half).alias("lon_max")))


def _has(low, *phrases: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_col(low), F.lit(p)) for p in phrases])


def months_back(low) -> Column:
    return (F.when(_has(low, "last 6 months", "past 6 months"), 6)
            .when(_has(low, "last year", "past year"), 12)
            .when(_has(low, "last 3 months"), 3))


def year_asked(low) -> Column:
    """First 20xx year; only where no relative time was given."""
    year = F.regexp_extract(_col(low), r"(20\d{2})", 1)
    return F.when(months_back(low).isNull() & (year != ""), year.cast("int"))


def season_asked(low) -> Column:
    """True where only a season word constrains the time."""
    return F.coalesce(months_back(low).isNull() & year_asked(low).isNull()
                      & _has(low, *rules.SEASON_WORDS), F.lit(False))


def season_word(low) -> Column:
    """Season with a month table named in the text, earliest in table order."""
    return F.coalesce(*[F.when(_has(low, s), F.lit(s)) for s in rules.SEASON_MONTHS])


def constraints(df: DataFrame, ruleset: str = "base", match: str = "longest",
                text: str = "text") -> DataFrame:
    """Add region or point box, time constraint and season of each text.

    The text is lower-cased once; a named region goes before a coordinate pair.
    """
    box = F.coalesce(region_box("_low", ruleset, match), point_box(text, ruleset))
    found = df.withColumn("_low", F.lower(F.col(text))).withColumns({
        "_box": box, "months_back": months_back("_low"), "year_asked": year_asked("_low"),
        "seasonal": season_asked("_low"), "season": season_word("_low")})
    return found.select(
        *df.columns, F.col("_box.name").alias("region_name"),
        *[F.col(f"_box.{c}").alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
        "months_back", "year_asked", "seasonal", "season")


_WORD_EDGE = r"[^\p{L}\p{N}_]"  # letters of any script count as part of a word


def _any_of(low: Column, tokens: Column, words: list[str], mode: str) -> Column:
    """Any word in the text. Tokens are looked up in a hash set, phrases searched."""
    words = list(dict.fromkeys(words))
    if mode == "substring":
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    single = [f for w in words if " " not in w for f in (w, w + "s")]
    test = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in single]))
    for w in (w for w in words if " " in w):
        whole = low.rlike(f"(?:^|{_WORD_EDGE}){re.escape(w)}s?(?:$|{_WORD_EDGE})")
        test = test | (F.contains(low, F.lit(w)) & whole)
    return test


def in_scope(df: DataFrame, out: str = "in_scope", text: str = "text",
             mode: str = "token") -> DataFrame:
    """Ocean or generic word present, no off-topic word, three characters at least.

    ``token`` matches whole words with an optional plural s, so 'car' does not
    reject 'carbon'; ``substring`` matches anywhere.
    """
    low, tokens = F.col("_low"), F.col("_tokens")
    split = F.split(F.lower(F.col(text)), f"{_WORD_EDGE}+") if mode == "token" else (
        F.array().cast("array<string>"))
    wanted = _any_of(low, tokens, rules.OCEAN_WORDS + rules.GENERIC_WORDS, mode)
    unwanted = _any_of(low, tokens, rules.OFF_TOPIC_WORDS, mode)
    flag = F.coalesce((F.length(F.trim(F.col(text))) >= 3) & wanted & ~unwanted, F.lit(False))
    return (df.withColumns({"_low": F.lower(F.col(text)), "_tokens": split})
            .withColumn(out, flag).drop("_low", "_tokens"))


# fixed values: variable marks in a catalogue row and the words for them
PARAMETER_WORDS = {
    "base": [("temp", "temperature"), ("psal|salinity", "salinity"), ("doxy|oxygen", "dissolved oxygen"),
             ("chla|chlorophyll", "chlorophyll"), ("nitrate", "nitrate")],
    "enhanced": [("temp", "temperature"), ("psal|salinity", "salinity"), ("doxy|oxygen", "oxygen")],
}


def parameter_phrases(variables_text, ruleset: str = "base") -> Column:
    """Words for the variables named in the text, in alphabetical order."""
    low = F.lower(_col(variables_text))
    hits = [F.when(low.rlike(mark), F.lit(word)) for mark, word in PARAMETER_WORDS[ruleset]]
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def like_pattern(word: str) -> str:
    """User text as a LIKE pattern that matches it literally, anywhere."""
    escaped = word.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{escaped}%"


def keyword_match(word: str, columns: list[str]) -> Column:
    """Case-insensitive literal match in any of the columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.col(c)).like(like_pattern(word))
    return test
