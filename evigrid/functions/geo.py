"""Geographic column expressions: distances, boxes, grids, projections. All run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
FEET_PER_METRE = 3.280839895


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def bbox(lat: Column, lon: Column, radius_m: float) -> dict[str, Column]:
    """The box around a point that holds all points within the radius."""
    dlat = F.lit(radius_m / METRES_PER_DEGREE)
    dlon = F.lit(radius_m) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return {"min_lat": lat - dlat, "max_lat": lat + dlat, "min_lon": lon - dlon, "max_lon": lon + dlon}


def within(lat: Column, lon: Column, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """Whether a point lies in a box, edges included; false for a point without coordinates."""
    return F.coalesce(lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon), F.lit(False))


def raster_cell(lat: Column, lon: Column, origin_lat: float, origin_lon: float, size: float) -> tuple[Column, Column]:
    """Row and column of a point on a north-up grid, rounding half to even."""
    return F.bround((F.lit(origin_lat) - lat) / size).cast("long"), F.bround((lon - F.lit(origin_lon)) / size).cast("long")


def utm_zone(lat: Column, lon: Column) -> Column:
    """UTM zone and hemisphere, such as 18N."""
    zone = (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
    return F.concat(zone.cast("string"), F.when(lat >= 0, "N").otherwise("S"))


def equal_grid_cell(lat: Column, lon: Column, distance_km: float) -> Column:
    """Name of the cell of a global grid of about equal distances: rows U/D of the equator, columns R/L of the meridian."""
    step = distance_km * 1000 / METRES_PER_DEGREE
    row = F.floor(lat / step).cast("int")
    col = F.floor(lon * F.greatest(F.cos(F.radians((row + 0.5) * step)), F.lit(1e-6)) / step).cast("int")
    name = lambda i, plus, minus: F.concat(F.abs(i).cast("string"), F.when(i >= 0, plus).otherwise(minus))
    return F.concat(name(row, "U", "D"), F.lit("_"), name(col, "R", "L"))


def _lambert() -> tuple[float, ...]:
    """e, n, a * F, rho0, lam0, x0 and the foot of the Long Island state plane (Lambert conic, two standard parallels, GRS80)."""
    # Ellipsoid, standard parallels, origin and false easting.
    a, f = 6378137.0, 1 / 298.257222101
    phi1, phi2, phi0, lam0 = (math.radians(x) for x in (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60, -74.0))
    x0, us_foot = 300000.0, 1200 / 3937
    e = math.sqrt(2 * f - f * f)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.log(m(phi1) / m(phi2)) / math.log(t(phi1) / t(phi2))
    big_f = m(phi1) / (n * t(phi1) ** n)
    return e, n, a * big_f, a * big_f * t(phi0) ** n, lam0, x0, us_foot


def lambert_feet(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in US feet of the Long Island state plane."""
    e, n, af, rho0, lam0, x0, us_foot = _lambert()
    sin = F.sin(F.radians(lat))
    tt = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - F.lit(e) * sin) / (1 + F.lit(e) * sin), F.lit(e / 2))
    rho, theta = F.lit(af) * F.pow(tt, F.lit(n)), F.lit(n) * (F.radians(lon) - F.lit(lam0))
    return (F.lit(x0) + rho * F.sin(theta)) / us_foot, (F.lit(rho0) - rho * F.cos(theta)) / us_foot


def from_lambert_feet(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Latitude and longitude of a place of the Long Island state plane: the latitude by fixed-point iteration, which gains about two digits a round."""
    e, n, af, rho0, lam0, x0, us_foot = _lambert()
    east, north = x * us_foot - F.lit(x0), F.lit(rho0) - y * us_foot
    t = F.pow(F.hypot(east, north) / F.lit(af), F.lit(1 / n))
    turn = lambda phi, _: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - F.lit(e) * F.sin(phi)) / (1 + F.lit(e) * F.sin(phi)), F.lit(e / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(math.pi / 2) - 2 * F.atan(t), turn)
    return F.degrees(phi), F.degrees(F.atan2(east, north) / F.lit(n) + F.lit(lam0))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """x and y of the centroid of the area within a closed ring of struct(x, y); the mean of the corners of a ring without area, null without corners."""
    first = F.get(ring, F.lit(0))  # sums are taken from the first corner on, so that they stay small
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct((p.x - first.x).alias("a"), (p.y - first.y).alias("b"), (q.x - first.x).alias("c"), (q.y - first.y).alias("d")))
    add = lambda s, g: F.struct((s.area + g.a * g.d - g.c * g.b).alias("area"), (s.x + (g.a + g.c) * (g.a * g.d - g.c * g.b)).alias("x"), (s.y + (g.b + g.d) * (g.a * g.d - g.c * g.b)).alias("y"), (s.mx + g.a).alias("mx"), (s.my + g.b).alias("my"), (s.n + 1).alias("n"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("area", "x", "y", "mx", "my", "n")])
    s = F.aggregate(edges, zero, add)
    at = lambda c: F.when(s.area != 0, s[c] / (3 * s.area)).when(s.n > 0, s[f"m{c}"] / s.n).when(F.size(ring) > 0, 0.0)
    return first.x + at("x"), first.y + at("y")


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in a polygon: an array of closed rings of struct(x, y), by the even-odd rule."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(ring, F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        crossed = lambda s: ((s.p.y > y) != (s.q.y > y)) & (x < (s.q.x - s.p.x) * (y - s.p.y) / (s.q.y - s.p.y) + s.p.x)
        return F.size(F.filter(edges, lambda s: s.q.isNotNull() & F.when(s.p.y == s.q.y, False).otherwise(crossed(s))))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, n: a + n) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area within a closed ring of struct(x, y), by the shoelace formula."""
    edges = F.zip_with(ring, F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p.x * q.y - q.x * p.y)
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, s: a + F.coalesce(s, F.lit(0.0)))) / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from the line of a closed ring."""
    edges = F.zip_with(ring, F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.when(q.isNotNull(), segment_distance(x, y, p.x, p.y, q.x, q.y)))
    return F.array_min(edges)
