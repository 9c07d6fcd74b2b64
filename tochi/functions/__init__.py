"""Column functions: the parsing rules of raw records and small arithmetic.

All are JVM expressions, so they stay inside code generation and are pushed where
Catalyst wants them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tochi.schema import EARTH_RADIUS_KM, WALK_METRES_PER_MINUTE

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
#: White space as Unicode has it, separators of text files among it.
WHITE = r"[\s\x0B\x1C-\x1F\x85\pZ]"
# Era prefixes and the year before their first.
ERAS = (("昭和", 1925), ("平成", 1988), ("令和", 2018))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def narrow(text: Column) -> Column:
    """Full-width digits as ASCII digits; other characters stay."""
    return F.translate(text, WIDE_DIGITS, DIGITS)


def number(text: Column) -> Column:
    """The first unsigned number of a text, commas and square metres aside; else null."""
    plain = F.replace(F.replace(narrow(text), F.lit(","), F.lit("")), F.lit("㎡"), F.lit(""))
    return F.nullif(F.regexp_extract(plain, r"[0-9]+(\.[0-9]+)?", 0), F.lit("")).cast("double")


def four_digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(narrow(text), "[0-9]{4}", 0), F.lit("")).cast("int")


def transaction_year(text: Column) -> Column:
    """The first run of four digits as a year; eras are not read here."""
    return four_digits(text)


def building_year(text: Column) -> Column:
    """Four digits, else an era year; null for other eras and for first years."""
    in_era = F.nullif(F.regexp_extract(narrow(text), "[0-9]+", 0), F.lit("")).cast("int")
    before_era = F.lit(None).cast("int")
    for name, before in reversed(ERAS):
        before_era = F.when(F.startswith(text, F.lit(name)), F.lit(before)).otherwise(before_era)
    return F.coalesce(four_digits(text), in_era + before_era)


def building_age(year: Column, built: Column) -> Column:
    """Years between, never negative; null if either year is."""
    return F.when(year.isNotNull() & built.isNotNull(), F.greatest(F.lit(0), year - built)).cast("double")


def walking_minutes(text: Column) -> Column:
    """Minutes from a distance text: bands first, then the first number, else 0."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0.0)
        .when(F.contains(text, F.lit("30分")) & F.contains(text, F.lit("60分")), 45.0)
        .when(F.contains(text, F.lit("1H")) | F.contains(text, F.lit("1時間")), 60.0)
        .otherwise(F.coalesce(number(text), F.lit(0.0)))
    )


def station_key(name: Column) -> Column:
    """Canonical key of a station name: before any bracket, small kana as large, without white space of any script around."""
    plain = F.substring_index(F.translate(name, "（）ヶヵ", "()ケカ"), "(", 1)
    return F.regexp_replace(plain, f"^{WHITE}+|{WHITE}+$", "")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, rounded to a millimetre so that engines agree on order."""
    p, q = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p) * F.cos(q) * half_lon * half_lon
    return F.round(2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 6)


def walk_from_km(km: Column) -> Column:
    """Whole minutes on foot, at least one."""
    return F.when(km.isNotNull(), F.greatest(F.lit(1), F.ceil(F.round(km * 1000 / WALK_METRES_PER_MINUTE, 6))).cast("long"))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def mean(x: Column, weight: str | None = None) -> Column:
    """The mean of what is not null; a row stands for ``weight`` equal ones if that is named."""
    return F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.avg(x)


def count_if(x: Column, weight: str | None = None) -> Column:
    """How many rows fulfil ``x``; a row stands for ``weight`` equal ones if that is named."""
    return F.coalesce(F.sum(F.when(x, F.col(weight))), F.lit(0).cast("long")) if weight else F.count_if(x)


def exact_mean(x: Column, weight: str | None = None) -> Column:
    """A mean whose sum is exact in cents, so it does not depend on the order of rows."""
    cents = x.cast("decimal(18,2)")
    if weight:
        return F.sum(cents * F.col(weight).cast("decimal(19,0)")).cast("double") / F.sum(F.when(x.isNotNull(), F.col(weight)))
    return F.sum(cents).cast("double") / F.count(x)


def rounded(x: Column, digits: int) -> Column:
    """Rounding with halves up in plain double arithmetic, which every engine does alike."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits
