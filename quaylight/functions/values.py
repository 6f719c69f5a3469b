"""Column expressions over numbers, times, places and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INDUSTRIES, RELATION_TYPES, WINDOW_DAYS


def finite(x: Column) -> Column:
    """A double, or null for what is no finite number."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def risk_band(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= 0.7, "high").when(score >= 0.4, "moderate").otherwise("low")


def sic_to_industry(sic: Column) -> Column:
    two = sic.substr(1, 2)
    return F.when(two.isin("35", "36"), "Electronics").when(two.isin("13", "29", "49"), "Energy").otherwise("Other")


def one_hot(value: Column, names: list[str], other: str | None = None) -> list[Column]:
    """0/1 doubles; unknown values count as `other`, or as none."""
    known = F.when(value.isin(names), value).otherwise(F.lit(other))
    return [F.coalesce((known == n).cast("double"), F.lit(0.0)).alias(n) for n in names]


def industry_features(industry: Column) -> list[Column]:
    return [c.alias(f"industry_{n}") for n, c in zip(INDUSTRIES, one_hot(industry, INDUSTRIES, "Other"), strict=True)]


def relation_features(kind: Column) -> list[Column]:
    return [c.alias(f"type_{n}") for n, c in zip(RELATION_TYPES, one_hot(kind, RELATION_TYPES), strict=True)]


def window_days(source: Column) -> Column:
    return reduce(lambda c, kv: c.when(source == kv[0], kv[1]), WINDOW_DAYS.items(), F.when(F.lit(False), 0)).otherwise(30)


def log_count(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(251.0)))


def age(seconds: Column, days: Column) -> Column:
    return F.least(F.lit(1.0), seconds / (86_400 * days))


def cosine_unit(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, held to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def bbox(lat: Column, lon: Column, radius_km: Column) -> Column:
    """struct(west, south, east, north) in degrees; null off the supported area or across the antimeridian."""
    dy = radius_km / 111.32
    dx = dy / F.cos(F.radians(lat))
    box = F.struct(*[F.round(v, 7).alias(n) for n, v in (("west", lon - dx), ("south", lat - dy), ("east", lon + dx), ("north", lat + dy))])
    return F.when((F.abs(lat) <= 80) & (radius_km > 0) & (radius_km <= 20) & (lon - dx >= -180) & (lon + dx <= 180), box)


def tile(lat: Column, lon: Column) -> Column:
    """hXXvYY of the 10-degree grid."""
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.lit("h"), two((lon + 180) / 10), F.lit("v"), two((90 - lat) / 10))


def tile_of_box(box: Column) -> Column:
    """The tile that holds the whole box, else null."""
    corner = tile(box["north"], box["west"])
    return F.when(corner == tile(box["south"], box["east"]), corner)


def pixel_center(h: Column, v: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """(lat, lon) of a pixel of a 2400 x 2400 tile."""
    return 90 - 10 * v - (row + 0.5) / 240, -180 + 10 * h + (col + 0.5) / 240


def month_range(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def default_windows(today: Column) -> tuple[Column, Column, Column, Column]:
    """Recent days (start, end) and months (before, after) that are collected where none are named."""
    month = F.trunc(today, "month")
    return F.date_sub(today, 37), F.date_sub(today, 7), F.add_months(month, -2), F.add_months(month, -1)


def ndvi(red: Column, near: Column) -> Column:
    return (near - red) / F.greatest(near + red, F.lit(1e-6))


def parse_utc(text: Column, naive: bool = True) -> Column:
    """A timestamp; texts without an offset are UTC, or null if naive is False."""
    at = text.try_cast("timestamp")
    return at if naive else F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), at)


def case_status(reported: Column, published_at: Column, now: Column) -> Column:
    past = F.unix_micros(now) - F.unix_micros(published_at)
    return F.when(reported == "historical", "historical").when(past.between(0, 30 * 86_400_000_000), "ongoing_as_reported").otherwise("current_status_unverified")
