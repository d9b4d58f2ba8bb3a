"""Fixes, vectors and receiver quality as windows over a machine's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BIN_M, FRAME_MS, JITTER_MM, NO_HEIGHT, PARKED_MPH, PARKED_MS, RTK_MS, STABLE_MS, STALE_MS
from ..functions import geo
from .quantiles import exact_percentiles
from . import grid, nearest
from .loops import cut, few

c = F.col


def per_machine(order: str = "fast_ms") -> Window:
    return Window.partitionBy("machine_id").orderBy(order)


def changes(rows: DataFrame, state: str, order: str = "fast_ms") -> DataFrame:
    """Rows where a machine's state differs from the one before, with old and new."""
    return rows.withColumn("old", F.lag(state).over(per_machine(order))).where(c("old") != c(state)).withColumnRenamed(state, "new")


def calibrated(rows: DataFrame, shift: DataFrame) -> DataFrame:
    """rows (lat, lon, height) moved by their field's de, dn and dh; sentinel heights stay."""
    got = grid.shifted(rows.join(shift, "field_id"), c("de"), c("dn"))
    return got.withColumn("height", F.when(c("height") == NO_HEIGHT, c("height")).otherwise(c("height") + c("dh"))).drop("de", "dn", "dh")


def valid_fixes(fixes: DataFrame) -> DataFrame:
    """fixes with valid: there is a position not within a degree of (0, 0) and the next reader sees it at most 2 s later (age_ms)."""
    there = c("lat").isNotNull() & c("lon").isNotNull() & ~((F.abs("lat") <= 1) & (F.abs("lon") <= 1))
    return fixes.withColumn("valid", there & (c("age_ms") <= STALE_MS))


#: Side of the tiles in which points ask for benchmarks, in metres, and benchmarks of all tiles that are broadcast, counted.
TILE_M, FEW_MARKS = 2 * BIN_M, 400_000


def nearest_benchmark(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (field_id, e, n, elevation_m) with the nearest benchmark of their field (ties: by name) and the differences to it.

    The points of a tile ask only those benchmarks that may be the nearest to a place in it, so a point's work follows the
    benchmarks around it and not those of its field. A point without a place gets the first by name.
    """
    mark = F.struct("name", c("e").alias("me"), c("n").alias("mn"), c("elevation_m").alias("mh"))
    first = few(marks.groupBy("field_id").agg(F.min(mark).alias("__first")))
    there = F.abs(c("e")) + F.abs(c("n")) < float("inf")
    tile = lambda v: F.when(there, F.floor(c(v) / TILE_M).cast("int"))
    placed = points.withColumn("__bx", tile("e")).withColumn("__by", tile("n"))
    held = placed.where(there).groupBy("field_id", c("__bx").alias("bx"), c("__by").alias("by_")).agg(F.min("e").alias("x0"), F.min("n").alias("y0"), F.max("e").alias("x1"), F.max("n").alias("y1"))
    corners = held.select("field_id", "bx", "by_", F.inline(F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))])))
    near = nearest.nearest_of_tiles(corners, marks.select("field_id", c("name").alias("seq"), c("e").alias("x"), c("n").alias("y"), c("elevation_m").alias("mh")))
    lists = near.groupBy("field_id", c("bx").alias("__bx"), c("by_").alias("__by")).agg(F.collect_list(F.struct(c("seq").alias("name"), c("px").alias("me"), c("py").alias("mn"), "mh")).alias("__marks"))
    lists = cut(lists)
    total = lists.agg(F.sum(F.size("__marks"))).first()[0] or 0
    lists = F.broadcast(lists) if total <= FEW_MARKS else lists.hint("merge")
    got = placed.join(lists, ["field_id", "__bx", "__by"], "left").join(first, "field_id", "left")
    far = F.transform("__marks", lambda m: F.struct((F.pow(m["me"] - c("e"), 2) + F.pow(m["mn"] - c("n"), 2)).alias("d2"), m["name"].alias("name"), m["me"].alias("me"), m["mn"].alias("mn"), m["mh"].alias("mh")))
    some = grid.let(got, __near=F.array_min(far))
    got = some.withColumn("__best", F.when(there, F.struct(*[c(f"__near.{k}").alias(k) for k in ("name", "me", "mn", "mh")])).otherwise(c("__first"))).drop("__near")
    return got.withColumn("benchmark", c("__best.name")).withColumn("de", c("__best.me") - c("e")).withColumn("dn", c("__best.mn") - c("n")).withColumn("dh", c("__best.mh") - c("elevation_m")).drop("__bx", "__by", "__marks", "__first", "__best")


def asof(fixes: DataFrame, vectors: DataFrame, columns: list[str], order: str = "fast_ms") -> DataFrame:
    """fixes with the columns of the last vector of their machine at or before them: one union and one window, no range join."""
    tagged = fixes.withColumn("__v", F.lit(None).cast(vectors.select(F.struct(*columns).alias("v")).schema["v"].dataType)).withColumn("__kind", F.lit(1))
    other = [F.lit(None).cast(t).alias(n) for n, t in fixes.dtypes if n not in ("machine_id", order)]
    both = tagged.unionByName(vectors.select("machine_id", order, *other, F.struct(*columns).alias("__v"), F.lit(0).alias("__kind")))
    w = Window.partitionBy("machine_id").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__kind = 1")
    return got.select(*fixes.columns, *[c(f"__v.{x}").alias(x) for x in columns])


def jitter(fixes: DataFrame, frame_ms: int = FRAME_MS, order: str = "fast_ms") -> DataFrame:
    """fixes with jitter_mm: the farthest that a fixed position in the trailing frame lies from the mean of the frame.

    The frame is bounded in time, so its list is, too.
    """
    w = Window.partitionBy("machine_id").orderBy(order).rangeBetween(-frame_ms, 0)
    fixed = F.when(c("rtk") == "Fix", F.struct("lat", "lon"))
    got = fixes.withColumn("frame", F.collect_list(fixed).over(w))
    mean = lambda x: F.aggregate(F.transform("frame", lambda p: p[x]), F.lit(0.0), lambda a, v: a + v) / F.size("frame")
    got = got.withColumn("lat0", F.when(F.size("frame") > 0, mean("lat"))).withColumn("lon0", F.when(F.size("frame") > 0, mean("lon")))

    def metres(p: Column) -> Column:
        e, n = geo.local_mm(p["lat"], p["lon"], c("lat0"), c("lon0"))
        return F.sqrt(e * e + n * n)

    return got.withColumn("jitter_mm", F.array_max(F.transform("frame", metres))).withColumn("n_frame", F.size("frame")).drop("frame", "lat0", "lon0")


def dwell(rows: DataFrame, holds: Column, name: str, gap_ms: int = STALE_MS, order: str = "fast_ms") -> DataFrame:
    """rows with name: for how long the condition has held without a break; a gap over gap_ms breaks it, too."""
    w = per_machine(order)
    broken = ~F.coalesce(holds, F.lit(False)) | (c(order) - F.lag(order).over(w) > gap_ms)
    got = rows.withColumn("__holds", F.coalesce(holds, F.lit(False))).withColumn("__island", F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(c("__holds"), c(order))).over(Window.partitionBy("machine_id", "__island"))
    return got.withColumn(name, F.when(c("__holds"), c(order) - first).otherwise(0)).drop("__holds", "__island")


def quality(fixes: DataFrame, order: str = "fast_ms") -> DataFrame:
    """fixes with state: NoFix, NoRtk, Unstable, Stable or HighQuality, from the three timers and the jitter of the frame."""
    got = jitter(fixes, order=order)
    slow = c("speed_kph") / 1.609344 < PARKED_MPH
    got = dwell(got, c("rtk") == "Fix", "rtk_ms", order=order)
    got = dwell(got, (c("rtk") == "Fix") & slow, "parked_ms", order=order)
    got = dwell(got, (c("rtk") == "Fix") & (c("jitter_mm") <= JITTER_MM), "stable_ms", order=order)
    high = (c("rtk_ms") >= RTK_MS) & (c("parked_ms") >= PARKED_MS) & (c("stable_ms") >= STABLE_MS)
    state = F.when(c("rtk") == "None", "NoFix").when(c("rtk") != "Fix", "NoRtk").when(high, "HighQuality").when(c("stable_ms") >= STABLE_MS, "Stable").otherwise("Unstable")
    return got.withColumn("state", state)


def median_position(fixes: DataFrame) -> DataFrame:
    """(machine_id, lat, lon, n): exact medians of the fixed positions of each machine, by distributed selection."""
    fixed = fixes.where(c("rtk") == "Fix")
    lat = exact_percentiles(fixed, ["machine_id"], "lat", {"lat": 0.5}, [F.count("*").alias("n")])
    return lat.join(exact_percentiles(fixed, ["machine_id"], "lon", {"lon": 0.5}), "machine_id").select("machine_id", "lat", "lon", "n")


def blade_edges(rows: DataFrame, width_m: float, order: str = "fast_ms") -> DataFrame:
    """rows (run_id, lat, lon, heading_deg) with the blade's left and right ends and those of the row before in the same run."""
    for name, turn in (("left", -90.0), ("right", 90.0)):
        lat, lon = geo.move(c("lat"), c("lon"), c("heading_deg") + turn, F.lit(width_m / 2))
        rows = rows.withColumn(f"{name}_lat", lat).withColumn(f"{name}_lon", lon)
    w = Window.partitionBy("machine_id", "run_id").orderBy(order)
    for name in ("left_lat", "left_lon", "right_lat", "right_lon"):
        rows = rows.withColumn(f"previous_{name}", F.lag(name).over(w))
    return rows


def runs(rows: DataFrame, mode: str, order: str = "fast_ms") -> DataFrame:
    """rows with run_id: it grows whenever the mode changes."""
    w = per_machine(order)
    new = (F.lag(mode).over(w).isNull() | (F.lag(mode).over(w) != c(mode))).cast("int")
    return rows.withColumn("run_id", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def course(fixes: DataFrame, least_m: float = 1.0, order: str = "fast_ms") -> DataFrame:
    """fixes with course_deg, the bearing from the fix before where the machine has moved by more than least_m, and gyro_offset_deg, the heading's turn to it."""
    w = per_machine(order)
    a, b = F.lag("lat").over(w), F.lag("lon").over(w)
    got = fixes.withColumn("moved_m", geo.haversine(a, b, c("lat"), c("lon")))
    got = got.withColumn("course_deg", F.when(c("moved_m") > least_m, geo.bearing(a, b, c("lat"), c("lon"))))
    return got.withColumn("gyro_offset_deg", geo.signed_turn(c("heading_deg"), c("course_deg")))


def tilt_corrected(fixes: DataFrame) -> DataFrame:
    """fixes (roll_deg, pitch_deg, antenna_height_m, antenna_right_m, antenna_forward_m, heading_deg, altitude_m) with the position on the ground under the machine."""
    h = c("antenna_height_m")
    right = h * F.sin(F.radians("roll_deg")) + c("antenna_right_m") * F.cos(F.radians("roll_deg"))
    ahead = h * F.sin(F.radians("pitch_deg")) + c("antenna_forward_m") * F.cos(F.radians("pitch_deg"))
    lat, lon = geo.move(c("lat"), c("lon"), c("heading_deg"), -ahead)
    lat, lon = geo.move(lat, lon, c("heading_deg") + 90.0, -right)
    down = h * F.cos(F.radians("roll_deg")) * F.cos(F.radians("pitch_deg"))
    return fixes.withColumn("ground_lat", lat).withColumn("ground_lon", lon).withColumn("ground_m", c("altitude_m") - down)


def densified(fixes: DataFrame, step_ms: int = 50, order: str = "fast_ms") -> DataFrame:
    """Dead-reckoned positions every step_ms from each fix to before the next one: metres by speed along the heading."""
    until = F.lead(order).over(per_machine(order))
    got = fixes.withColumn("__until", F.coalesce(until - 1, c(order)))
    got = got.withColumn("at_ms", F.explode(F.sequence(c(order), c("__until"), F.lit(step_ms))))
    metres = c("speed_kph") * (c("at_ms") - c(order)) / 3600.0
    lat, lon = geo.move(c("lat"), c("lon"), c("heading_deg"), metres)
    return got.withColumn("metres", metres).withColumn("at_lat", lat).withColumn("at_lon", lon).drop("__until")


def swept_polygons(ticks: DataFrame, width_m: float, order: str = "seq") -> DataFrame:
    """ticks (machine_id, x, y, heading_deg, mode) with ring and swept_m2: the quadrilateral between a blade's edge and that of the tick before in the same run of its mode; the first tick of a run has none."""
    rows = runs(ticks, "mode", order)
    east, north = F.cos(F.radians("heading_deg")) * (width_m / 2), -F.sin(F.radians("heading_deg")) * (width_m / 2)
    rows = rows.withColumn("left", F.struct((c("x") - east).alias("x"), (c("y") - north).alias("y"))).withColumn("right", F.struct((c("x") + east).alias("x"), (c("y") + north).alias("y")))
    w = Window.partitionBy("machine_id", "run_id").orderBy(order)
    rows = rows.withColumn("ring", F.when(F.lag("left").over(w).isNotNull(), F.array(F.lag("left").over(w), F.lag("right").over(w), c("right"), c("left"))))
    twice = lambda i, j: c("ring")[i]["x"] * c("ring")[j]["y"] - c("ring")[j]["x"] * c("ring")[i]["y"]
    return rows.withColumn("swept_m2", F.abs(twice(0, 1) + twice(1, 2) + twice(2, 3) + twice(3, 0)) / 2).drop("left", "right")
