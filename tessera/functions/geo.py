"""Country and region of a location text, as ordered tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and codes. Fixed values.
US_NAMES = "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming usa".split() + ["new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota", "west virginia", "district of columbia", "united states"]
US_CODES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
COUNTRIES = [("canada", "Canada", "canada"), ("united kingdom", "United Kingdom", "uk"), ("england", "United Kingdom", "uk"), ("scotland", "United Kingdom", "uk"), ("wales", "United Kingdom", "uk"), ("sweden", "Sweden", "nordics"), ("denmark", "Denmark", "nordics"), ("finland", "Finland", "nordics"), ("norway", "Norway", "nordics"), ("switzerland", "Switzerland", "switzerland"), ("australia", "Australia", "australia"), ("hong kong", "Hong Kong", "hong_kong"), ("singapore", "Singapore", "singapore"), ("china", "China", "mainland_china")]
BOARD_COUNTRIES = [("united kingdom", "United Kingdom", "uk"), ("england", "United Kingdom", "uk"), ("scotland", "United Kingdom", "uk"), ("wales", "United Kingdom", "uk"), ("canada", "Canada", "canada"), ("australia", "Australia", "australia"), ("hong kong", "Hong Kong", "hong_kong"), ("singapore", "Singapore", "singapore"), ("china", "China", "mainland_china")]
TAG_REGIONS = [("us", "us"), ("canada", "canada"), ("uk", "uk"), ("nordics", "nordics"), ("europe", "eu")]


def place(country: str, region: str) -> Column:
    return F.struct(F.lit(country).alias("country"), F.lit(region).alias("region"))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), otherwise)


def infer(location: Column) -> Column:
    """Country and region that a location names, by whole words; states and their codes first."""
    raw = F.coalesce(location, F.lit(""))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(raw), "[^a-z]+", " ")), F.lit(" "))
    us = F.rlike(words, F.lit(f" (?:{'|'.join(US_NAMES)}) ")) | F.rlike(raw, F.lit(rf"(?U)\b(?:{'|'.join(US_CODES)})\b"))
    cases = [(F.trim(words) == "", place("", "")), (us, place("United States", "us"))]
    return first_of(cases + [(words.contains(f" {m} "), place(c, r)) for m, c, r in COUNTRIES], place("", ""))


def of_source(country: Column, region: Column, location: Column, tags: Column) -> Column:
    """The configured country and region where either is set, else what the location holds, else the first telling tag."""
    country, region, low = F.coalesce(country, F.lit("")), F.coalesce(region, F.lit("")), F.lower(F.coalesce(location, F.lit("")))
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    cases = [((country != "") | (region != ""), F.struct(country.alias("country"), region.alias("region")))]
    cases += [(low.contains(m), place(c, r)) for m, c, r in BOARD_COUNTRIES] + [(F.array_contains(tags, t), place("", r)) for t, r in TAG_REGIONS]
    return first_of(cases, place("", ""))
