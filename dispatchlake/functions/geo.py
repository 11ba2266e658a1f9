"""Distances on a local plane and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE_M = 111_320.0  # metres of a degree of latitude


def dist_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """PRJ-30: metres between two points on a plane that touches the first."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1)) * DEGREE_M
    dy = (lat2 - lat1) * DEGREE_M
    return F.sqrt(dx * dx + dy * dy)


def seg_dist_m(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> tuple[Column, Column]:
    """PRJ-30: metres from a point to a segment, and the share of the segment at its nearest place."""
    k = F.cos(F.radians(lat)) * DEGREE_M
    ax, ay, bx, by = (a_lon - lon) * k, (a_lat - lat) * DEGREE_M, (b_lon - lon) * k, (b_lat - lat) * DEGREE_M
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py), t


def cell(lat: Column, lon: Column, digits: int = 3) -> tuple[Column, Column]:
    """PRJ-31: integer grid cell of a point at so many decimals (from whole micro-degrees, so rounding is exact)."""
    step = 10 ** (6 - digits)
    micro = lambda c: F.floor(c * 1_000_000 + 0.5)
    return tuple(F.floor((micro(c) + step // 2) / step).cast("long") for c in (lat, lon))
