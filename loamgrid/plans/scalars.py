"""Queries on the column expressions: each is a step of a keyed job over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BIN_M
from ..functions import geo, registered
from ..operators import cover, grid
from .base import bins, query, rounded, utm_sql, view

c = F.col
_A = f"{geo.WGS84_A}e0"


@query("P01_to_utm_in_sql", "SELECT field_id, seq, 15 AS zone, round(e, 3) AS e, round(n, 3) AS n FROM utm", "utm")
def p01s(spark, sf) -> DataFrame:
    registered.register(spark)
    rows = spark.sql("SELECT field_id, seq, utm_zone(lon) AS zone, to_utm(lat, lon) AS at FROM {points}", points=view(spark, sf, "v_points"))
    return rounded(rows.select("field_id", "seq", "zone", "at.e", "at.n"), 3)


@query("P01_to_utm", "SELECT field_id, seq, 15 AS zone, round(e, 3) AS e, round(n, 3) AS n FROM utm", "utm")
def p01(spark, sf) -> DataFrame:
    return rounded(grid.georeferenced(view(spark, sf, "v_points")).select("field_id", "seq", "zone", "e", "n"), 3)


@query("P02_from_utm", "SELECT field_id, seq, round(lat, 8) AS lat2, round(lon, 8) AS lon2 FROM v_points", "v_points")
def p02(spark, sf) -> DataFrame:
    lat, lon = geo.from_utm(c("e"), c("n"), c("zone"))
    return grid.georeferenced(view(spark, sf, "v_points")).select("field_id", "seq", F.round(lat, 8).alias("lat2"), F.round(lon, 8).alias("lon2"))


@query(
    "P03_offset",
    f"WITH o AS (SELECT field_id, name, lat, lon, {utm_sql('lat', 'lon')[0]} AS e, {utm_sql('lat', 'lon')[1]} AS n FROM v_benchmarks) SELECT field_id, name, round(e + 12.5e0, 3) AS e, round(n - 7.25e0, 3) AS n FROM o",
    "v_benchmarks",
)
def p03(spark, sf) -> DataFrame:
    moved = grid.shifted(view(spark, sf, "v_benchmarks").select("field_id", "name", "lat", "lon"), F.lit(12.5), F.lit(-7.25))
    return rounded(grid.georeferenced(moved).select("field_id", "name", "e", "n"), 3)


_HAV = f"2 * {_A} * asin(sqrt(least(1.0e0, pow(sin(radians(lat - 36.0005e0) / 2), 2) + cos(radians(36.0005e0)) * cos(radians(lat)) * pow(sin(radians(lon + 93.4995e0) / 2), 2))))"
_BEAR = "degrees(atan2(sin(radians(lon + 93.4995e0)) * cos(radians(lat)), cos(radians(36.0005e0)) * sin(radians(lat)) - sin(radians(36.0005e0)) * cos(radians(lat)) * cos(radians(lon + 93.4995e0))))"
def _here() -> tuple:
    return F.lit(36.0005), F.lit(-93.4995)



@query("P04_haversine", f"SELECT field_id, seq, round({_HAV}, 4) AS metres FROM v_points", "v_points")
def p04(spark, sf) -> DataFrame:
    return rounded(view(spark, sf, "v_points").select("field_id", "seq", geo.haversine(*_here(), c("lat"), c("lon")).alias("metres")))


@query("P05_bearing", f"WITH b AS (SELECT field_id, seq, {_BEAR} AS d FROM v_points) SELECT field_id, seq, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS degrees FROM b", "v_points")
def p05(spark, sf) -> DataFrame:
    return rounded(view(spark, sf, "v_points").select("field_id", "seq", geo.bearing(*_here(), c("lat"), c("lon")).alias("degrees")))


_MOVE = f"""WITH q AS (SELECT machine_id, event_id, radians(lon) AS l0, radians(lat) AS p0, radians(heading_deg) AS h, {{m}} / {_A} AS d FROM v_fixes),
r AS (SELECT *, asin(sin(p0) * cos(d) + cos(p0) * sin(d) * cos(h)) AS p FROM q)
SELECT machine_id, event_id, round(degrees(p), 8) AS lat2, round(degrees(l0 + atan2(sin(h) * sin(d) * cos(p0), cos(d) - sin(p0) * sin(p))), 8) AS lon2 FROM r"""


@query("P06_move", _MOVE.format(m="speed_kph"), "v_fixes")
def p06(spark, sf) -> DataFrame:
    lat, lon = geo.move(c("lat"), c("lon"), c("heading_deg"), c("speed_kph"))
    return view(spark, sf, "v_fixes").select("machine_id", "event_id", F.round(lat, 8).alias("lat2"), F.round(lon, 8).alias("lon2"))


@query("P28_point_ahead", _MOVE.format(m="80.0e0"), "v_fixes")
def p28(spark, sf) -> DataFrame:
    lat, lon = geo.move(c("lat"), c("lon"), c("heading_deg"), F.lit(80.0))
    return view(spark, sf, "v_fixes").select("machine_id", "event_id", F.round(lat, 8).alias("lat2"), F.round(lon, 8).alias("lon2"))


@query(
    "P07_local_mm",
    f"""WITH w AS (SELECT machine_id, event_id, lat, lon, 1 - {geo.E2!r}e0 * pow(sin(radians(36.0e0)), 2) AS w FROM v_fixes)
SELECT machine_id, event_id, round(radians(lon + 93.5e0) * {_A} / sqrt(w) * cos(radians(36.0e0)) * 1000, 3) AS east_mm, round(radians(lat - 36.0e0) * {_A} * (1 - {geo.E2!r}e0) / (w * sqrt(w)) * 1000, 3) AS north_mm FROM w""",
    "v_fixes",
)
def p07(spark, sf) -> DataFrame:
    e, n = geo.local_mm(c("lat"), c("lon"), F.lit(36.0), F.lit(-93.5))
    return rounded(view(spark, sf, "v_fixes").select("machine_id", "event_id", e.alias("east_mm"), n.alias("north_mm")), 3)


@query(
    "P07b_flat_offsets",
    f"""WITH m AS (SELECT field_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM v_points GROUP BY field_id)
SELECT field_id, seq, round(radians(lon - lon0) * cos(radians(lat0)) * {_A}, 4) AS x, round(radians(lat - lat0) * {_A}, 4) AS y, round(lat, 8) AS lat2, round(lon, 8) AS lon2 FROM v_points JOIN m USING (field_id)""",
    "v_points",
)
def p07b(spark, sf) -> DataFrame:
    pts = view(spark, sf, "v_points")
    mean = pts.groupBy("field_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = geo.flat_xy(c("lat"), c("lon"), c("lat0"), c("lon0"))
    got = pts.join(mean, "field_id").withColumn("x", x).withColumn("y", y)
    lat, lon = geo.flat_latlon(c("x"), c("y"), c("lat0"), c("lon0"))
    return got.select("field_id", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lat, 8).alias("lat2"), F.round(lon, 8).alias("lon2"))


@query("P08_bin_index", "SELECT field_id, seq, bx, by_ FROM binned", "binned")
def p08(spark, sf) -> DataFrame:
    return grid.binned(grid.georeferenced(view(spark, sf, "v_points"))).select("field_id", "seq", "bx", "by_")


@query(
    "P09_bin_corners",
    f"SELECT b.field_id, bx, by_, round(min_e + bx * {BIN_M}e0, 3) AS corner_e, round(min_n + by_ * {BIN_M}e0, 3) AS corner_n, round(min_e + (bx + 0.5e0) * {BIN_M}e0, 3) AS centre_e, round(min_n + (by_ + 0.5e0) * {BIN_M}e0, 3) AS centre_n FROM bins b JOIN extents USING (field_id)",
    "bins",
)
def p09(spark, sf) -> DataFrame:
    pts = grid.georeferenced(view(spark, sf, "v_points"))
    ext = grid.field_extents(pts)
    got = grid.bin_means(grid.binned(pts, ext)).join(ext.select("field_id", "min_e", "min_n"), "field_id")
    return rounded(got.select("field_id", "bx", "by_", geo.bin_corner(c("bx"), c("min_e")).alias("corner_e"), geo.bin_corner(c("by_"), c("min_n")).alias("corner_n"), geo.bin_centre(c("bx"), c("min_e")).alias("centre_e"), geo.bin_centre(c("by_"), c("min_n")).alias("centre_n")), 3)


@query(
    "P10_relative_elevation",
    "WITH m AS (SELECT field_id, min_by(elevation_m, name) AS master FROM v_benchmarks GROUP BY field_id) SELECT field_id, name, round(elevation_m - master + 30.48e0, 4) AS relative_m FROM v_benchmarks JOIN m USING (field_id)",
    "v_benchmarks",
)
def p10(spark, sf) -> DataFrame:
    from ..operators import survey

    marks = view(spark, sf, "v_benchmarks")
    master = marks.groupBy("field_id").agg(F.min_by("elevation_m", "name").alias("master_m"))
    return rounded(survey.relative_elevations(marks, master, "field_id").select("field_id", "name", "relative_m"))


@query(
    "P11_elevation_repair",
    """WITH s AS (SELECT field_id, seq, existing + CASE WHEN field_id = 1 THEN 300.0e0 ELSE 0.0e0 END AS z FROM v_points),
a AS (SELECT field_id, max(z) > 180.48e0 AS legacy, min_by(z, seq) AS anchor FROM s GROUP BY field_id)
SELECT field_id, seq, round(CASE WHEN legacy THEN z - anchor + 30.48e0 ELSE z END, 9) AS elevation_m FROM s JOIN a USING (field_id)""",
    "v_points",
)
def p11(spark, sf) -> DataFrame:
    from ..operators import survey

    pts = view(spark, sf, "v_points").select("field_id", "seq", F.lit("interior").alias("kind"), (c("existing") + F.when(c("field_id") == 1, 300.0).otherwise(0.0)).alias("elevation_m"))
    return rounded(survey.repaired_elevations(pts, "field_id").select("field_id", "seq", "elevation_m"), 9)


@query(
    "P12_angles",
    """WITH p AS (SELECT machine_id, event_id, heading_deg AS b, lag(heading_deg) OVER (PARTITION BY machine_id ORDER BY fast_ms) AS a FROM v_fixes),
t AS (SELECT *, (b - a + 180.0e0) - 360.0e0 * floor((b - a + 180.0e0) / 360.0e0) - 180.0e0 AS turn FROM p WHERE a IS NOT NULL)
SELECT machine_id, event_id, turn AS signed_turn, abs(turn) AS turn, round((a + turn * 0.35e0) - 360.0e0 * floor((a + turn * 0.35e0) / 360.0e0), 4) AS blended, round(sin(radians(b)), 6) AS east, round(cos(radians(b)), 6) AS north FROM t""",
    "v_fixes",
)
def p12(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    got = view(spark, sf, "v_fixes").withColumn("a", F.lag("heading_deg").over(Window.partitionBy("machine_id").orderBy("fast_ms"))).where("a IS NOT NULL")
    b = c("heading_deg")
    e, n = geo.heading_vector(b)
    return got.select("machine_id", "event_id", geo.signed_turn(c("a"), b).alias("signed_turn"), geo.turn(c("a"), b).alias("turn"), F.round(geo.blend(c("a"), b, 0.35), 4).alias("blended"), F.round(e, 6).alias("east"), F.round(n, 6).alias("north"))


@query("P13_dms", "SELECT field_id, name, round(lat, 7) AS lat2, round(lon, 7) AS lon2 FROM v_benchmarks", "v_benchmarks")
def p13(spark, sf) -> DataFrame:
    text = view(spark, sf, "v_benchmarks").withColumn("a", geo.degrees_to_dms(c("lat"), "N", "S")).withColumn("b", geo.degrees_to_dms(c("lon"), "E", "W"))
    return text.select("field_id", "name", F.round(geo.dms_to_degrees(c("a")), 7).alias("lat2"), F.round(geo.dms_to_degrees(c("b")), 7).alias("lon2"))


@query("P14_units", "SELECT field_id, name, round(elevation_m / 0.3048e0, 6) AS feet, round(elevation_m / 1.30795061931439e0, 6) AS m3 FROM v_benchmarks", "v_benchmarks")
def p14(spark, sf) -> DataFrame:
    return view(spark, sf, "v_benchmarks").select("field_id", "name", F.round(geo.m_to_feet(c("elevation_m")), 6).alias("feet"), F.round(geo.cy_to_m3(c("elevation_m")), 6).alias("m3"))


@query("P15_sentinels", "WITH s AS (SELECT *, CASE WHEN bx % 7 = 0 THEN -1000.0e0 ELSE z END AS stored FROM v_grid) SELECT field_id, bx, by_, nullif(stored, -1000.0e0) AS height, coalesce(nullif(stored, -1000.0e0), -1000.0e0) AS written FROM s", "v_grid")
def p15(spark, sf) -> DataFrame:
    from ..operators import tables

    stored = view(spark, sf, "v_grid").withColumn("stored", F.when(c("bx") % 7 == 0, -1000.0).otherwise(c("z")))
    got = tables.heights_from_stored(stored, "stored", "height")
    return tables.heights_to_stored(got, "height", "written").select("field_id", "bx", "by_", "height", "written")


_BAND = "CASE WHEN d > 0.8 THEN 8 WHEN d > 0.5 THEN 7 WHEN d > 0.05 THEN 6 WHEN d > 0.01 THEN 5 WHEN d >= -0.01 THEN 4 WHEN d >= -0.05 THEN 3 WHEN d >= -0.5 THEN 2 WHEN d >= -0.8 THEN 1 ELSE 0 END"


@query("P16_cut_fill_band", f"WITH d AS (SELECT *, round(existing - target, 6) AS d FROM bins) SELECT field_id, bx, by_, {_BAND} AS band FROM d", "bins")
def p16(spark, sf) -> DataFrame:
    return bins(spark, sf).select("field_id", "bx", "by_", geo.cut_fill_band(F.round(c("existing") - c("target"), 6)).alias("band"))


@query(
    "P17_completion",
    """WITH cur AS (SELECT *, round(existing + CASE bx % 3 WHEN 0 THEN 0.0e0 WHEN 1 THEN (target - existing) / 2 ELSE target - existing END, 6) AS now FROM bins)
SELECT field_id, bx, by_, CASE WHEN abs(now - round(target, 6)) <= 0.01 THEN 'done' WHEN abs(now - round(existing, 6)) <= 0.01 THEN 'untouched' ELSE 'partial' END AS class FROM cur""",
    "bins",
)
def p17(spark, sf) -> DataFrame:
    gap = c("target") - c("existing")
    now = F.round(c("existing") + F.when(c("bx") % 3 == 0, 0.0).when(c("bx") % 3 == 1, gap / 2).otherwise(gap), 6)
    return bins(spark, sf).select("field_id", "bx", "by_", geo.completion(F.round("existing", 6), now, F.round("target", 6)).alias("class"))


def _step(name: str, steps: int, flat: int) -> None:
    @query(
        name,
        f"WITH r AS (SELECT field_id, min(z) AS lo, max(z) AS hi FROM v_grid GROUP BY field_id) SELECT field_id, bx, by_, CASE WHEN hi > lo THEN CAST(greatest(0, least({steps - 1}, floor((z - lo) / (hi - lo) * {steps}))) AS INT) ELSE {flat} END AS step FROM v_grid JOIN r USING (field_id)",
        "v_grid",
    )
    def steps_of(spark, sf) -> DataFrame:
        cells = view(spark, sf, "v_grid")
        low_high = cells.groupBy("field_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
        return cells.join(low_high, "field_id").select("field_id", "bx", "by_", geo.share_of_range(c("z"), c("lo"), c("hi"), steps, flat).alias("step"))


_step("P18_colour_index", 256, 128)
_step("P19_survey_band", 9, 4)


@query(
    "P18_palette",
    """WITH s AS (SELECT field_id, seq, CAST(seq % 256 AS INT) AS step FROM v_points), k AS (SELECT *, (240.0e0 - step / 255.0e0 * 240.0e0) / 60 AS k FROM s), x AS (SELECT *, 1 - abs(k % 2 - 1) AS x FROM k)
SELECT field_id, seq, step, CAST(floor(CASE WHEN k < 1 THEN 1 WHEN k < 2 THEN x ELSE 0 END * 255) AS INT) AS r, CAST(floor(CASE WHEN k < 1 THEN x WHEN k < 3 THEN 1 WHEN k < 4 THEN x ELSE 0 END * 255) AS INT) AS g,
  CAST(floor(CASE WHEN k < 2 THEN 0 WHEN k < 3 THEN x ELSE 1 END * 255) AS INT) AS b FROM x""",
    "v_points",
)
def p18p(spark, sf) -> DataFrame:
    step = (c("seq") % 256).cast("int")
    return view(spark, sf, "v_points").select("field_id", "seq", step.alias("step"), geo.elevation_colour(step).alias("p")).select("field_id", "seq", "step", "p.r", "p.g", "p.b")


@query(
    "P20_slopes",
    "WITH s AS (SELECT field_id, count(*) AS n, 0.2e0 AS main, 0.1e0 AS crossing FROM v_points GROUP BY field_id) SELECT field_id, round(-main / 100, 6) AS a, round(crossing / 100, 6) AS b, round(sqrt(main * main + crossing * crossing), 6) AS slope_pct, round(90 + degrees(atan2(crossing, main)), 4) AS heading FROM s",
    "v_points",
)
def p20(spark, sf) -> DataFrame:
    a, b = geo.plane_slopes(0.2, 0.1, 90.0)
    fields = view(spark, sf, "v_points").select("field_id").distinct().withColumn("a", F.lit(a)).withColumn("b", F.lit(b))
    slope, heading = geo.composite_slope(c("a"), c("b"))
    return fields.select("field_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(slope, 6).alias("slope_pct"), F.round(heading, 4).alias("heading"))


_TILES = """WITH x AS (SELECT field_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM v_points GROUP BY field_id),
z AS (SELECT *, CAST(unnest(range(14, 23)) AS INT) AS zoom FROM x),
t AS (SELECT field_id, zoom, CAST(floor((w + 180) / 360 * pow(2, zoom)) AS BIGINT) - 3 AS x0, CAST(floor((e + 180) / 360 * pow(2, zoom)) AS BIGINT) + 3 AS x1,
  CAST(floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * pow(2, zoom)) AS BIGINT) - 3 AS y0, CAST(floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * pow(2, zoom)) AS BIGINT) + 3 AS y1 FROM z),
a AS (SELECT field_id, zoom, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t), tiles AS (SELECT field_id, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM a)
"""


@query("P21_tile_cover", _TILES + "SELECT * FROM tiles", "v_points")
def p21(spark, sf) -> DataFrame:
    return cover.tiles(_extent(spark, sf)).select("field_id", "zoom", "x", "y")


@query("S13_tile_manifest", _TILES + "SELECT field_id, zoom, count(*) AS n_tiles, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM tiles GROUP BY field_id, zoom", "v_points")
def s13(spark, sf) -> DataFrame:
    return cover.tile_manifest(cover.tiles(_extent(spark, sf)))


def _extent(spark, sf) -> DataFrame:
    return view(spark, sf, "v_points").groupBy("field_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query(
    "P22_runoff",
    "WITH r AS (SELECT field_id, bx, by_, CAST(10 + bx AS DOUBLE) AS rain, 25400.0e0 / 85 - 254 AS s FROM v_grid) SELECT field_id, bx, by_, round(CASE WHEN rain > 0.2e0 * s THEN pow(rain - 0.2e0 * s, 2) / (rain + 0.8e0 * s) ELSE 0 END, 6) AS runoff_mm FROM r",
    "v_grid",
)
def p22(spark, sf) -> DataFrame:
    return view(spark, sf, "v_grid").select("field_id", "bx", "by_", F.round(geo.runoff_mm((c("bx") + 10).cast("double"), 85.0), 6).alias("runoff_mm"))


@query("P23_true_heading", "WITH h AS (SELECT machine_id, event_id, heading_deg - 2 - 30 / 60.0e0 AS h FROM v_fixes) SELECT machine_id, event_id, round(h - 360 * floor(h / 360), 6) AS heading FROM h", "v_fixes")
def p23(spark, sf) -> DataFrame:
    return view(spark, sf, "v_fixes").select("machine_id", "event_id", F.round(geo.true_heading(c("heading_deg"), F.lit(-2.0), F.lit(30.0)), 6).alias("heading"))


@query(
    "P24_load_and_percent",
    """WITH l AS (SELECT field_id, sum(CASE WHEN op_id % 3 <> 0 THEN -delta_m ELSE 0 END) AS cut, sum(abs(delta_m)) AS planned FROM v_op_bins GROUP BY field_id)
SELECT field_id, round(cut * 1.3e0, 4) AS loose, round(100 * cut / planned, 4) AS percent, round(planned - cut, 4) AS remaining FROM l""",
    "v_op_bins",
)
def p24(spark, sf) -> DataFrame:
    from ..operators import ledger

    done = view(spark, sf, "v_op_bins").groupBy("field_id").agg(F.sum(F.when(c("op_id") % 3 != 0, -c("delta_m")).otherwise(0.0)).alias("done"), F.sum(F.abs("delta_m")).alias("planned"))
    return rounded(ledger.load_and_progress(done).select("field_id", "loose", "percent", "remaining"))


@query(
    "P25_pixels",
    """WITH p AS (SELECT field_id, bx, by_, 36.001e0 - (by_ + 0.5e0) / 400 * 0.001e0 AS lat, -93.5e0 + (bx + 0.5e0) / 50 * 0.00075e0 AS lon, CAST(bx - 20 AS DOUBLE) AS dx, CAST(by_ - 10 AS DOUBLE) AS dy FROM v_grid),
d AS (SELECT *, degrees(atan2(dx, 0 - dy)) AS h FROM p) SELECT field_id, bx, by_, round(lat, 8) AS lat, round(lon, 8) AS lon, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) AS heading FROM d""",
    "v_grid",
)
def p25(spark, sf) -> DataFrame:
    lat, lon = geo.pixel_to_latlon(c("bx") + 0.5, c("by_") + 0.5, F.lit(50.0), F.lit(400.0), F.lit(36.001), F.lit(36.0), F.lit(-93.49925), F.lit(-93.5))
    heading = geo.direction_north_up((c("bx") - 20).cast("double"), (c("by_") - 10).cast("double"))
    return view(spark, sf, "v_grid").select("field_id", "bx", "by_", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"), F.round(heading, 6).alias("heading"))


@query(
    "P26_grey_ramps",
    """WITH g AS (SELECT field_id, bx, by_, z - min(z) OVER (PARTITION BY field_id) AS d, max(z) OVER (PARTITION BY field_id) - min(z) OVER (PARTITION BY field_id) AS deepest FROM v_grid),
k AS (SELECT field_id, bx, by_, CAST(round((1 - least(greatest(d * 5, 0), 10) / 10) * 255) AS INT) AS flow_grey, CAST(round((1 - pow(d / deepest, 0.25e0)) * 255) AS INT) AS pond_grey FROM g)
SELECT *, CAST(255 - round(pond_grey * 60 / 100.0e0) AS INT) AS alpha FROM k""",
    "v_grid",
)
def p26(spark, sf) -> DataFrame:
    cells = view(spark, sf, "v_grid")
    low_high = cells.groupBy("field_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    got = cells.join(low_high, "field_id").withColumn("d", c("z") - c("lo"))
    got = got.select("field_id", "bx", "by_", geo.flow_grey(c("d") * 5).alias("flow_grey"), geo.pond_grey(c("d"), c("hi") - c("lo")).alias("pond_grey"))
    return got.withColumn("alpha", geo.grey_alpha(c("pond_grey"), 60.0))
