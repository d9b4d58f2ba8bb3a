"""Geodesy, angles, units and classes as column expressions. All are built-in functions, so plans stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BIN_M, CY_PER_M3, SPHERE_M, UTM_K0, WGS84_A, WGS84_F

E2 = WGS84_F * (2 - WGS84_F)
EP2 = E2 / (1 - E2)


def wrapped(deg: Column) -> Column:
    """A longitude or difference of longitudes within -180 to 180 degrees; one that lies there keeps its bits."""
    return F.when(F.abs(deg) > 180.0, deg - 360.0 * F.round(deg / 360.0)).otherwise(deg)


def utm_zone(lon: Column) -> Column:
    """Zone by longitude alone, 1 to 60; longitudes are wrapped, so 180 is in zone 1 as -180 is."""
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def utm_angles(lat: Column, lon: Column, zone: Column) -> dict[str, Column]:
    """What the series of to_utm is made of: latitude in radians, its sine, cosine and tangent, sines of its multiples, and the angle from the zone's meridian. Each is worth keeping as a column."""
    p = F.radians(lat)
    return {"p": p, "s": F.sin(p), "c": F.cos(p), "t": F.tan(p), "s2": F.sin(2 * p), "s4": F.sin(4 * p), "s6": F.sin(6 * p), "l": F.radians(wrapped(lon - (zone * 6 - 183)))}


def utm_series(lat: Column, of: dict[str, Column]) -> tuple[Column, Column]:
    """(easting, northing) in metres from utm_angles by the transverse Mercator series; null outside -80..84 degrees."""
    p, s, c = of["p"], of["s"], of["c"]
    t = of["t"] * of["t"]
    n = WGS84_A / F.sqrt(1 - E2 * s * s)
    cc = EP2 * c * c
    a = c * of["l"]
    m = WGS84_A * (
        (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * p
        - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * of["s2"]
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * of["s4"]
        - (35 * E2**3 / 3072) * of["s6"]
    )
    a2 = a * a
    east = 500000.0 + UTM_K0 * n * a * (1 + (1 - t + cc) * a2 / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * EP2) * a2 * a2 / 120)
    north = UTM_K0 * (m + n * of["t"] * a2 * (0.5 + (5 - t + 9 * cc + 4 * cc * cc) * a2 / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * EP2) * a2 * a2 / 720))
    valid = lat.between(-80.0, 84.0)
    return F.when(valid, east), F.when(valid, north + F.when(lat < 0, 10000000.0).otherwise(0.0))


def to_utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) in metres; null outside -80..84 degrees."""
    return utm_series(lat, utm_angles(lat, lon, utm_zone(lon) if zone is None else zone))


def footpoint(north: Column, is_north: Column | None = None) -> Column:
    """The latitude in radians on the central meridian that has the northing."""
    is_north = F.lit(True) if is_north is None else is_north
    m = (north - F.when(is_north, 0.0).otherwise(10000000.0)) / UTM_K0
    mu = m / (WGS84_A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    return mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)


def from_footpoint(p: Column, east: Column, zone: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a place in a zone from its footpoint and easting."""
    s, c = F.sin(p), F.cos(p)
    t, cc = F.tan(p) * F.tan(p), EP2 * c * c
    w = 1 - E2 * s * s
    n, r = WGS84_A / F.sqrt(w), WGS84_A * (1 - E2) / (w * F.sqrt(w))
    d = (east - 500000.0) / (n * UTM_K0)
    d2 = d * d
    lat = p - (n * F.tan(p) / r) * d2 * (0.5 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * EP2) * d2 / 24 + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * EP2 - 3 * cc * cc) * d2 * d2 / 720)
    lon = d * (1 - (1 + 2 * t + cc) * d2 / 6 + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * EP2 + 24 * t * t) * d2 * d2 / 120) / c
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)


def from_utm(east: Column, north: Column, zone: Column, is_north: Column | None = None) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a place in a zone."""
    return from_footpoint(footpoint(north, is_north), east, zone)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360, clockwise from north."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return normal(F.degrees(F.atan2(y, x)))


def move(lat: Column, lon: Column, heading: Column, metres: Column) -> tuple[Column, Column]:
    """The place so many metres along a great circle of the sphere."""
    d, p, h = metres / SPHERE_M, F.radians(lat), F.radians(heading)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h))
    l = F.radians(lon) + F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))  # noqa: E741
    return F.degrees(q), F.degrees(l)


def local_mm(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(east, north) millimetres from a reference, with the ellipsoid's radii there."""
    s = F.sin(F.radians(lat0))
    w = 1 - E2 * s * s
    meridian, prime = WGS84_A * (1 - E2) / (w * F.sqrt(w)), WGS84_A / F.sqrt(w)
    return F.radians(lon - lon0) * prime * F.cos(F.radians(lat0)) * 1000.0, F.radians(lat - lat0) * meridian * 1000.0


def flat_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * SPHERE_M, F.radians(lat - lat0) * SPHERE_M


def flat_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + F.degrees(y / SPHERE_M), lon0 + F.degrees(x / (SPHERE_M * F.cos(F.radians(lat0))))


def bin_index(v: Column, low: Column, size: float = BIN_M) -> Column:
    return F.floor((v - low) / size).cast("int")


def bin_corner(index: Column, low: Column, size: float = BIN_M) -> Column:
    return low + index * size


def bin_centre(index: Column, low: Column, size: float = BIN_M) -> Column:
    return low + (index + 0.5) * size


def normal(deg: Column) -> Column:
    """An angle in 0 to 360 degrees."""
    return F.pmod(deg, F.lit(360.0))


def signed_turn(a: Column, b: Column) -> Column:
    """From a to b, -180 to 180 degrees, positive clockwise."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def turn(a: Column, b: Column) -> Column:
    return F.abs(signed_turn(a, b))


def blend(a: Column, b: Column, share: Column | float) -> Column:
    return normal(a + signed_turn(a, b) * share)


def heading_vector(deg: Column) -> tuple[Column, Column]:
    """(east, north) of a compass heading."""
    return F.sin(F.radians(deg)), F.cos(F.radians(deg))


def vector_heading(east: Column, north: Column) -> Column:
    return normal(F.degrees(F.atan2(east, north)))


def dms_to_degrees(text: Column) -> Column:
    """``36 5 24.5 N`` with any marks between the numbers; S and W, or a leading minus, are negative. Null if it is no such text."""
    part = lambda k: F.expr("null") if k is None else F.regexp_extract(text, r"(?i)^\s*(-?)\s*(\d+)\D+(\d+)\D+(\d+(?:\.\d+)?)\D*?([NSEW]?)\s*$", k)
    value = part(2).try_cast("double") + part(3).try_cast("double") / 60 + part(4).try_cast("double") / 3600
    return F.when(part(2) != "", F.when((part(1) == "-") | F.upper(part(5)).isin("S", "W"), -value).otherwise(value))


def degrees_to_dms(deg: Column, positive: str, negative: str) -> Column:
    tenths = F.round(F.abs(deg) * 36000000).cast("long")
    d, rest = F.floor(tenths / 36000000).cast("long"), tenths % 36000000
    return F.format_string("%d %d %s %s", d, F.floor(rest / 600000).cast("long"), (rest % 600000 / 10000.0).cast("decimal(8,4)").cast("string"), F.when(deg < 0, negative).otherwise(positive))


def feet_to_m(ft: Column) -> Column:
    return ft * 0.3048


def m_to_feet(m: Column) -> Column:
    return m / 0.3048


def cy_to_m3(cy: Column) -> Column:
    return cy / CY_PER_M3


def cut_fill_band(difference: Column) -> Column:
    """0 (deep fill) to 8 (deep cut) by existing minus target, at 0.8, 0.5, 0.05 and 0.01 metres either way."""
    band = F.when(difference > 0.8, 8).when(difference > 0.5, 7).when(difference > 0.05, 6).when(difference > 0.01, 5)
    return band.when(difference >= -0.01, 4).when(difference >= -0.05, 3).when(difference >= -0.5, 2).when(difference >= -0.8, 1).when(difference.isNotNull(), 0)


def completion(initial: Column, current: Column, target: Column, near: float = 0.01) -> Column:
    nodata = initial.isNull() | current.isNull() | target.isNull()
    return F.when(nodata, "nodata").when(F.abs(current - target) <= near, "done").when(F.abs(current - initial) <= near, "untouched").otherwise("partial")


def share_of_range(z: Column, low: Column, high: Column, steps: int, flat: int) -> Column:
    """Step 0 to steps - 1 of z in low..high; the step named flat where there is no range or no z."""
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((z - low) / (high - low) * steps))).cast("int")
    return F.when((high > low) & z.isNotNull() & ~F.isnan(z), step).otherwise(flat)


def elevation_colour(step: Column) -> Column:
    """(r, g, b), 0 to 255, of a colour step 0 to 255: hues from blue to red at full strength."""
    k = (240.0 - step / 255.0 * 240.0) / 60
    x = 1 - F.abs(k % 2 - 1)
    part = lambda full, rising: F.floor(F.when(full, 1.0).when(rising, x).otherwise(0.0) * 255).cast("int")
    return F.struct(part(k < 1, k < 2).alias("r"), part((k >= 1) & (k < 3), k < 4).alias("g"), part((k >= 3) & (k <= 4), (k >= 2) & (k < 3)).alias("b"))


def plane_slopes(main_pct: float, cross_pct: float, heading_deg: float) -> tuple[float, float]:
    """(a, b): rise per metre east and north of a plane that falls main_pct along the heading and cross_pct to its right."""
    h = math.radians(heading_deg)
    m, c = main_pct / 100, cross_pct / 100
    return -(m * math.sin(h) + c * math.cos(h)), -(m * math.cos(h) - c * math.sin(h))


def composite_slope(a: Column, b: Column) -> tuple[Column, Column]:
    """(slope in percent, downhill heading) of a plane."""
    return F.sqrt(a * a + b * b) * 100, vector_heading(-a, -b)


def runoff_mm(rain_mm: Column | float, curve_number: Column | float) -> Column:
    """SCS curve number: runoff depth of a rainfall."""
    rain, cn = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rain_mm, curve_number))
    s = 25400.0 / cn - 254.0
    return F.when(rain > 0.2 * s, F.pow(rain - 0.2 * s, 2) / (rain + 0.8 * s)).otherwise(0.0)


def true_heading(magnetic: Column, declination_deg: Column, declination_min: Column) -> Column:
    """Minutes have the sign of the degrees."""
    return normal(magnetic + declination_deg + F.when(declination_deg < 0, -declination_min).otherwise(declination_min) / 60.0)


def pixel_to_latlon(px: Column, py: Column, width: Column, height: Column, north: Column, south: Column, east: Column, west: Column) -> tuple[Column, Column]:
    return north - py / height * (north - south), west + px / width * (east - west)


def direction_north_up(dx: Column, dy: Column) -> Column:
    """Compass degrees of an image vector, whose y goes down."""
    return vector_heading(dx, -dy)


def flow_grey(accumulation: Column) -> Column:
    return F.round((1 - F.least(F.greatest(accumulation, F.lit(0.0)), F.lit(10.0)) / 10.0) * 255).cast("int")


def pond_grey(depth: Column, deepest: Column) -> Column:
    return F.when(deepest > 0, F.round((1 - F.pow(depth / deepest, 0.25)) * 255)).otherwise(255).cast("int")


def grey_alpha(grey: Column, opacity: Column | float) -> Column:
    return (255 - F.round(grey * opacity / 100.0)).cast("int")
