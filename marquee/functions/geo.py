"""Distances and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import CITIES


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rad = 3.141592653589793 / 180
    half_lat = F.sin((lat2 - lat1) * rad / 2)
    half_lng = F.sin((lng2 - lng1) * rad / 2)
    a = half_lat * half_lat + F.cos(lat1 * rad) * F.cos(lat2 * rad) * half_lng * half_lng
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nearest_city(lat: Column, lng: Column) -> Column:
    """Closest of the seven centroids; null without coordinates. No radius limit."""
    scored = F.array(*[
        F.struct(
            haversine_km(lat, lng, F.lit(c_lat), F.lit(c_lng)).alias("d"),
            F.lit(i).alias("i"),
            F.lit(key).alias("key"),
        )
        for i, (key, _, c_lat, c_lng) in enumerate(CITIES)
    ])
    return F.when(finite(lat) & finite(lng), F.array_min(scored)["key"])


def in_box(lat: Column, lng: Column, box=(26.5, 29.0, -83.5, -81.5)) -> Column:
    low_lat, high_lat, low_lng, high_lng = box
    inside = lat.between(low_lat, high_lat) & lng.between(low_lng, high_lng)
    return F.coalesce(inside & finite(lat) & finite(lng), F.lit(False))
