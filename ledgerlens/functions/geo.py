"""Regions as points, the distance between them and the speed a change of region implies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0088

# Region -> latitude, longitude of its centre.
REGIONS = {
    "Andijan": (40.7821, 72.3442),
    "Bukhara": (39.7747, 64.4286),
    "Fergana": (40.3864, 71.7864),
    "Jizzakh": (40.1158, 67.8422),
    "Karakalpakstan": (42.4600, 59.6100),
    "Kashkadarya": (38.8606, 65.7891),
    "Khorezm": (41.5500, 60.6333),
    "Namangan": (40.9983, 71.6726),
    "Navoi": (40.0844, 65.3792),
    "Samarkand": (39.6542, 66.9597),
    "Surkhandarya": (37.2242, 67.2783),
    "Syrdarya": (40.4897, 68.7842),
    "Tashkent City": (41.2995, 69.2401),
    "Tashkent Region": (41.0167, 69.3500),
}


def _coordinate(region: str, axis: int) -> str:
    pairs = ", ".join(f"'{name}', {at[axis]}D" for name, at in REGIONS.items())
    return f"try_element_at(map({pairs}), {region})"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in km as SQL; null when a coordinate is."""
    return (f"{2 * EARTH_RADIUS_KM}D * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))")


def distance_sql(a: str, b: str) -> str:
    """Distance between two named regions as SQL, null when one is unknown."""
    return haversine_sql(_coordinate(a, 0), _coordinate(a, 1), _coordinate(b, 0), _coordinate(b, 1))


def region_distance_km(a: str, b: str) -> Column:
    """The same as a column, from two column names."""
    return F.expr(distance_sql(a, b))


def implied_speed_kmh(distance_km: Column, seconds: Column) -> Column:
    """Speed over a distance in that time, counted as a second at least."""
    return distance_km / (F.greatest(seconds, F.lit(1.0)) / 3600.0)
