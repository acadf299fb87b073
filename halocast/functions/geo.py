"""Positions, distances and region labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from halocast import rules


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c) -> Column:
    """Six digits, with -0.0 folded into 0.0."""
    return F.round(_col(c), 6) + F.lit(0.0)


def mean6(c) -> Column:
    """Mean to six digits, from an exact decimal sum.

    The sum of doubles depends on the order of the tasks; this one does not.
    """
    c = _col(c)
    return F.round(F.sum(c.cast("decimal(24,12)")) / F.count(c), 6).cast("double")


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km (atan2 form)."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = (F.pow(F.sin(half_lat), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2))
    arc = F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
    return 2 * rules.EARTH_RADIUS_KM * arc


def in_box(lat, lon, lat_min, lat_max, lon_min, lon_max, wrap: bool = True) -> Column:
    """Inclusive box test. ``wrap`` reads lon_min > lon_max as crossing 180 degrees."""
    lat, lon, lat_min, lat_max, lon_min, lon_max = map(
        _col, (lat, lon, lat_min, lat_max, lon_min, lon_max))
    inside = lon.between(lon_min, lon_max)
    if wrap:
        inside = F.when(lon_min > lon_max, (lon >= lon_min) | (lon <= lon_max)).otherwise(inside)
    return lat.between(lat_min, lat_max) & inside


def box_filter(box: tuple, lat="lat", lon="lon", wrap: bool = True) -> Column:
    """Box with fixed bounds: plain comparisons, which reach the Parquet scan."""
    lat, lon = _col(lat), _col(lon)
    lat_min, lat_max, lon_min, lon_max = box
    if wrap and lon_min > lon_max:
        inside = (lon >= lon_min) | (lon <= lon_max)
    else:
        inside = (lon >= lon_min) & (lon <= lon_max)
    return (lat >= lat_min) & (lat <= lat_max) & inside


def center_lon(lon_min, lon_max) -> Column:
    """Middle of a box in longitude, across 180 degrees when it wraps."""
    lon_min, lon_max = _col(lon_min), _col(lon_max)
    plain = (lon_min + lon_max) / 2
    wrapped = (lon_min + lon_max + 360) / 2
    return F.when(lon_min <= lon_max, plain).otherwise(
        F.when(wrapped > 180, wrapped - 360).otherwise(wrapped))


def relevance(distance_km, ruleset: str = "base") -> Column:
    """1 at the centre, falling to 0 at the scale distance."""
    return F.greatest(F.lit(0.0), 1 - _col(distance_km) / rules.RELEVANCE_SCALE_KM[ruleset])


def matching_regions(lat, lon, ruleset: str = "base", wrap: bool = True) -> Column:
    """Array of the names of all regions that hold the point, in rule order."""
    hits = [F.when(box_filter((a, b, c, d), lat, lon, wrap), F.lit(name))
            for name, a, b, c, d in rules.REGIONS[ruleset]]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _ladder(steps: list[tuple[Column, str]], default: str | None) -> Column:
    first, *rest = steps
    expr = reduce(lambda acc, s: acc.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1])))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# Ladder labels and their limits below are fixed values.
def classify_region(lat="lat", lon="lon", ladder: str = "stats") -> Column:
    """First matching label. Ladders: stats, stats_basic, bands, answer, hemispheres."""
    lat, lon = _col(lat), _col(lon)
    arabian = lat.between(10, 25) & lon.between(50, 75)
    bengal = lat.between(5, 22) & lon.between(80, 100)
    low = lat.between(-10, 10)
    mediterranean = lat.between(30, 46) & lon.between(-6, 42)
    atlantic = lon.between(-80, 20)
    pacific = lon.between(120, 180) | lon.between(-180, -70)
    if ladder == "stats":
        return _ladder([(arabian, "Arabian Sea"), (bengal, "Bay of Bengal"), (low, "Equatorial"),
                        (mediterranean, "Mediterranean"), (atlantic, "Atlantic Ocean"),
                        (pacific, "Pacific Ocean")], "Other Region")
    if ladder == "stats_basic":
        return _ladder([(arabian, "Arabian Sea"), (low, "Equatorial"),
                        (mediterranean, "Mediterranean"), (atlantic, "Atlantic"),
                        (pacific, "Pacific")], "Other")
    if ladder == "bands":
        return _ladder([(low, "Equatorial"), (lat > 40, "Northern High"),
                        (lat < -40, "Southern High"), (lat > 0, "Northern Mid")], "Southern Mid")
    if ladder == "answer":
        return _ladder([(arabian, "Arabian Sea"), (bengal, "Bay of Bengal"),
                        (low, "equatorial waters"), (mediterranean, "Mediterranean Sea"),
                        (atlantic, "Atlantic Ocean"), (pacific, "Pacific Ocean")], None)
    if ladder == "hemispheres":
        known = lat.isNotNull() & lon.isNotNull()
        return _ladder([(known & arabian, "Arabian Sea"), (known & low, "Equatorial region"),
                        (known & (lat > 0), "Northern Hemisphere"),
                        (known, "Southern Hemisphere")], None)
    raise ValueError(f"unknown ladder: {ladder}")


def guess_basin(lat="lat", lon="lon", ruleset: str = "corrected") -> Column:
    """Ocean basin by longitude first.

    ``reference`` keeps the wide Atlantic arm (-180..-30); ``corrected`` gives
    -180..-70 to the Pacific.
    """
    lat, lon = _col(lat), _col(lon)
    north = lat > 0
    west = -180 if ruleset == "reference" else -70
    steps = [
        (lon.between(west, -30) & north, "North Atlantic"),
        (lon.between(west, -30), "South Atlantic"),
        (lon.between(-30, 20) & (lat > 30), "North Atlantic"),
        (lon.between(-30, 20) & (lat < -30), "South Atlantic"),
        (lon.between(-30, 20), "tropical Atlantic"),
        (lon.between(20, 120) & north, "North Indian Ocean"),
        (lon.between(20, 120), "South Indian Ocean"),
        ((lon.between(120, 180) | lon.between(-180, west)) & north, "North Pacific"),
        (lon.between(120, 180) | lon.between(-180, west), "South Pacific"),
    ]
    return F.when(lat.isNull() | lon.isNull(), F.lit(None)).otherwise(
        _ladder(steps, "Pacific Ocean"))


def format_position(lat="lat", lon="lon") -> Column:
    """``12.34°N, 56.78°W``; zero counts as N and E."""
    lat, lon = _col(lat), _col(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(
        "%.2f°%s, %.2f°%s",
        F.abs(lat), F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lon), F.when(lon >= 0, "E").otherwise("W")))


def signed_position(lat="lat", lon="lon", digits: int = 2) -> Column:
    """Signed values printed as N and E."""
    lat, lon = _col(lat), _col(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(),
                  F.format_string(f"%.{digits}f°N, %.{digits}f°E", lat, lon))


def valid_coordinates(lat="lat", lon="lon") -> Column:
    lat, lon = _col(lat), _col(lon)
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def season_of(ts) -> Column:
    month = F.month(_col(ts))
    steps = [(month.isin(*rules.SEASON_MONTHS[s]), s) for s in ("spring", "summer", "autumn", "winter")]
    return _ladder(steps, None)
