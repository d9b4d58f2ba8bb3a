"""Queries on bins: means, volumes, extents, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BIN_M, CY_PER_M3, M2_PER_ACRE
from ..functions import geo
from ..operators import cover, grid, tables
from ..operators.loops import shared_dir
from .base import bins, query, rounded, view
from .scalars import _BAND

c = F.col
KEY = grid.KEY
_CY = f"({BIN_M}e0 * {BIN_M}e0 * {CY_PER_M3}e0)"


def _points(spark, sf) -> DataFrame:
    return grid.georeferenced(view(spark, sf, "v_points"))


@query(
    "flagship_cut_fill_by_band",
    f"WITH d AS (SELECT *, round(existing - target, 6) AS d FROM bins) SELECT field_id, {_BAND} AS band, count(*) AS n_bins, round(sum(greatest(existing - target, 0)) * {_CY}, 4) AS cut_cy, round(sum(greatest(target - existing, 0)) * {_CY}, 4) AS fill_cy FROM d GROUP BY 1, 2",
    "bins",
)
def flagship(spark, sf) -> DataFrame:
    got = bins(spark, sf).withColumn("band", geo.cut_fill_band(F.round(c("existing") - c("target"), 6)))
    d, cy = c("existing") - c("target"), BIN_M * BIN_M * CY_PER_M3
    return rounded(got.groupBy("field_id", "band").agg(F.count("*").alias("n_bins"), (F.sum(F.greatest(d, F.lit(0.0))) * cy).alias("cut_cy"), (F.sum(F.greatest(-d, F.lit(0.0))) * cy).alias("fill_cy")))


@query("A01_bin_means", "SELECT field_id, bx, by_, round(existing, 9) AS existing, round(target, 9) AS target, n_points, round(greatest(existing - target, 0), 9) AS cut_m, round(greatest(target - existing, 0), 9) AS fill_m FROM bins", "bins")
def a01(spark, sf) -> DataFrame:
    return rounded(bins(spark, sf), 9)


@query(
    "A01_bin_means_strict",
    "SELECT field_id, bx, by_, round(avg(existing), 9) AS existing, round(avg(target), 9) AS target, count(*) AS n_points FROM binned WHERE bx < width AND by_ < height AND existing <> target GROUP BY field_id, bx, by_",
    "binned",
)
def a01s(spark, sf) -> DataFrame:
    return rounded(grid.bin_means(grid.binned(_points(spark, sf)), skip_level=True).drop("cut_m", "fill_m"), 9)


@query(
    "A02_dense_grid",
    "WITH x AS (SELECT field_id, unnest(range(width)) AS bx, height FROM extents), g AS (SELECT field_id, bx, unnest(range(height)) AS by_ FROM x) SELECT g.field_id, CAST(g.bx AS INT) AS bx, CAST(g.by_ AS INT) AS by_, round(existing, 9) AS existing, round(target, 9) AS target FROM g LEFT JOIN bins b ON g.field_id = b.field_id AND g.bx = b.bx AND g.by_ = b.by_",
    "bins",
)
def a02(spark, sf) -> DataFrame:
    pts = _points(spark, sf)
    ext = grid.field_extents(pts)
    return rounded(grid.dense(ext.select("field_id", "width", "height"), grid.bin_means(grid.binned(pts, ext)).select(*KEY, "existing", "target")).select(*KEY, "existing", "target"), 9)


@query("A03_extents", "SELECT x.field_id, round(min_e, 3) AS min_e, round(min_n, 3) AS min_n, round(max_e, 3) AS max_e, round(max_n, 3) AS max_n, width, height, round(centroid_lat, 7) AS centroid_lat, round(centroid_lon, 7) AS centroid_lon, 15 AS zone, n_points FROM extents x JOIN (SELECT field_id, avg(lat) AS centroid_lat, avg(lon) AS centroid_lon, count(*) AS n_points FROM v_points GROUP BY field_id) USING (field_id)", "extents")
def a03(spark, sf) -> DataFrame:
    got = grid.field_extents(_points(spark, sf))
    return got.select("field_id", *[F.round(x, 3).alias(x) for x in ("min_e", "min_n", "max_e", "max_n")], "width", "height", F.round("centroid_lat", 7).alias("centroid_lat"), F.round("centroid_lon", 7).alias("centroid_lon"), "zone", "n_points")


@query("A03_design_extents", f"SELECT field_id, round(min_e - {BIN_M}e0, 3) AS min_e, round(min_n - {BIN_M}e0, 3) AS min_n, CAST(ceil((max_e + {BIN_M}e0 - (min_e - {BIN_M}e0)) / {BIN_M}e0) AS INT) + 1 AS width, CAST(ceil((max_n + {BIN_M}e0 - (min_n - {BIN_M}e0)) / {BIN_M}e0) AS INT) + 1 AS height FROM extents", "extents")
def a03d(spark, sf) -> DataFrame:
    return rounded(grid.field_extents(_points(spark, sf), pad=True).select("field_id", "min_e", "min_n", "width", "height"), 3)


_VOL = f"round(sum(greatest(existing - target, 0)) * {_CY}, 4) AS planned_cut_cy, round(sum(greatest(target - existing, 0)) * {_CY}, 4) AS planned_fill_cy, count(*) AS n_bins, round(count(*) * {BIN_M}e0 * {BIN_M}e0 / {M2_PER_ACRE}e0, 4) AS acres"


@query("A04_volumes", f"SELECT field_id, {_VOL} FROM bins GROUP BY field_id", "bins")
def a04(spark, sf) -> DataFrame:
    return rounded(grid.volumes(bins(spark, sf)))


@query("A16_area", f"SELECT field_id, count(*) AS n_bins, round(count(*) * {BIN_M}e0 * {BIN_M}e0 / {M2_PER_ACRE}e0, 4) AS acres FROM bins GROUP BY field_id", "bins")
def a16(spark, sf) -> DataFrame:
    return rounded(grid.volumes(bins(spark, sf)).select("field_id", "n_bins", "acres"))


@query("J07_volume_join", f"WITH e AS (SELECT field_id, bx, by_, existing FROM bins WHERE bx % 5 <> 0), t AS (SELECT field_id, bx, by_, target FROM bins WHERE by_ % 5 <> 0) SELECT field_id, {_VOL} FROM e JOIN t USING (field_id, bx, by_) GROUP BY field_id", "bins")
def j07(spark, sf) -> DataFrame:
    got = bins(spark, sf)
    e, t = got.where("bx % 5 <> 0").select(*KEY, "existing"), got.where("by_ % 5 <> 0").select(*KEY, "target")
    return rounded(grid.volumes(e.join(t, KEY)))


@query("A08_ranges", "SELECT field_id, round(min(existing), 9) AS low, round(max(existing), 9) AS high FROM bins WHERE existing <> -1000 GROUP BY field_id", "bins")
def a08(spark, sf) -> DataFrame:
    return rounded(tables.elevation_ranges(bins(spark, sf), "existing"), 9)


@query("J01_points_to_bins", "SELECT p.field_id, p.seq, p.bx, p.by_, round(b.existing, 9) AS bin_existing FROM binned p JOIN bins b ON p.field_id = b.field_id AND p.bx = b.bx AND p.by_ = b.by_", "bins")
def j01(spark, sf) -> DataFrame:
    pts = grid.binned(_points(spark, sf))
    cells = grid.bin_means(pts).select(*KEY, F.round("existing", 9).alias("bin_existing"))
    return pts.select("field_id", "seq", "bx", "by_").join(cells, KEY).select("field_id", "seq", "bx", "by_", "bin_existing")


_LAYERS = "WITH e AS (SELECT field_id, bx, by_, existing FROM bins WHERE bx % 5 <> 0), t AS (SELECT field_id, bx, by_, target FROM bins WHERE by_ % 5 <> 0), h AS (SELECT field_id, bx, by_, n_points AS heading FROM bins WHERE (bx + by_) % 3 = 0)\n"


def _layers(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    got = bins(spark, sf)
    return got.where("bx % 5 <> 0").select(*KEY, "existing"), got.where("by_ % 5 <> 0").select(*KEY, "target"), got.where("(bx + by_) % 3 = 0").select(*KEY, c("n_points").alias("heading"))


@query("J06_layers", _LAYERS + "SELECT field_id, bx, by_, round(existing, 9) AS existing, round(target, 9) AS target, heading FROM e FULL JOIN t USING (field_id, bx, by_) FULL JOIN h USING (field_id, bx, by_)", "bins")
def j06(spark, sf) -> DataFrame:
    return rounded(tables.combined_layers(*_layers(spark, sf)), 9)


@query("S10_combined_export", _LAYERS + "SELECT field_id, concat_ws(',', bx, by_, coalesce(printf('%.9f', existing), ''), coalesce(printf('%.9f', target), ''), coalesce(CAST(heading AS VARCHAR), '')) AS line FROM e FULL JOIN t USING (field_id, bx, by_) FULL JOIN h USING (field_id, bx, by_)", "bins")
def s10(spark, sf) -> DataFrame:
    return tables.export_lines(tables.combined_layers(*_layers(spark, sf)), ["bx", "by_", "existing", "target", "heading"], 9).select("field_id", "line")


@query("U02_bin_keys", _LAYERS + "SELECT field_id, bx, by_ FROM e UNION SELECT field_id, bx, by_ FROM t", "bins")
def u02(spark, sf) -> DataFrame:
    e, t, _ = _layers(spark, sf)
    return e.select(*KEY).unionByName(t.select(*KEY)).distinct()


@query("U03_pending", _LAYERS + "SELECT field_id, bx, by_ FROM e EXCEPT SELECT field_id, bx, by_ FROM t", "bins")
def u03(spark, sf) -> DataFrame:
    e, t, _ = _layers(spark, sf)
    return e.select(*KEY).join(t, KEY, "left_anti")


@query("J09_unknown_bins", _LAYERS + "SELECT field_id, bx, by_ FROM e WHERE (field_id, bx, by_) NOT IN (SELECT field_id, bx, by_ FROM h)", "bins")
def j09(spark, sf) -> DataFrame:
    e, _, h = _layers(spark, sf)
    return e.select(*KEY).join(h, KEY, "left_anti")


@query("U04_masks", _LAYERS + "SELECT field_id, bx, by_, existing IS NOT NULL OR target IS NOT NULL AS either, existing IS NOT NULL AND target IS NOT NULL AS both_ FROM e FULL JOIN t USING (field_id, bx, by_)", "bins")
def u04(spark, sf) -> DataFrame:
    e, t, _ = _layers(spark, sf)
    got = e.join(t, KEY, "full")
    return got.select(*KEY, (c("existing").isNotNull() | c("target").isNotNull()).alias("either"), (c("existing").isNotNull() & c("target").isNotNull()).alias("both_"))


@query("U01_interior_and_boundary", "SELECT field_id, seq, false AS boundary FROM v_points WHERE seq % 10 <> 0 UNION ALL SELECT field_id, seq, true AS boundary FROM v_points WHERE seq % 10 = 0", "v_points")
def u01(spark, sf) -> DataFrame:
    pts = view(spark, sf, "v_points").select("field_id", "seq")
    return pts.where("seq % 10 <> 0").withColumn("boundary", F.lit(False)).unionByName(pts.where("seq % 10 = 0").withColumn("boundary", F.lit(True)))


@query("F01_valid_heights", "WITH s AS (SELECT *, CASE WHEN seq % 11 = 0 THEN -1000.0e0 WHEN seq % 13 = 0 THEN 0.0e0 ELSE existing END AS stored FROM v_points) SELECT field_id, seq, round(stored, 9) AS stored FROM s WHERE stored <> -1000 AND stored <> 0", "v_points")
def f01(spark, sf) -> DataFrame:
    pts = view(spark, sf, "v_points").withColumn("stored", F.when(c("seq") % 11 == 0, -1000.0).when(c("seq") % 13 == 0, 0.0).otherwise(c("existing")))
    return rounded(tables.valid_heights(pts, "stored").select("field_id", "seq", "stored"), 9)


@query("F03_single_zone", "WITH p AS (SELECT field_id, seq, lat, CASE WHEN seq % 17 = 0 THEN lon + 6 ELSE lon END AS lon FROM v_points) SELECT field_id, seq, CAST(floor((lon + 180) / 6) AS INT) + 1 AS zone, CAST(floor((lon + 180) / 6) AS INT) + 1 = 15 AS in_zone FROM p", "v_points")
def f03(spark, sf) -> DataFrame:
    pts = view(spark, sf, "v_points").withColumn("lon", F.when(c("seq") % 17 == 0, c("lon") + 6).otherwise(c("lon"))).withColumn("zone", geo.utm_zone(c("lon")))
    return tables.zone_check(pts).select("field_id", "seq", "zone", "in_zone")


@query("F04_grid_clip", "SELECT field_id, seq FROM binned WHERE bx BETWEEN 0 AND width - 1 AND by_ BETWEEN 0 AND height - 1", "binned")
def f04(spark, sf) -> DataFrame:
    return grid.binned(_points(spark, sf)).where(grid.in_grid()).select("field_id", "seq")


@query("F05_cut_bins", "SELECT field_id, bx, by_ FROM bins WHERE existing > target", "bins")
def f05(spark, sf) -> DataFrame:
    return bins(spark, sf).where("existing > target").select(*KEY)


@query(
    "F07_crop",
    "SELECT field_id, bx - CAST(floor(width / 4.0e0) AS INT) AS bx, by_, round(existing, 9) AS existing FROM bins JOIN extents USING (field_id) WHERE bx >= floor(width / 4.0e0) AND bx < floor(width / 4.0e0) + floor(width / 2.0e0) AND by_ < floor(height / 4.0e0)",
    "bins",
)
def f07(spark, sf) -> DataFrame:
    pts = _points(spark, sf)
    ext = grid.field_extents(pts)
    return rounded(tables.crop_centre_bottom(grid.bin_means(grid.binned(pts, ext)), ext).select(*KEY, "existing"), 9)


_HAUL_BINS = """WITH hu AS (SELECT field_id, seq, direction_deg, {E} AS e, {N} AS n FROM v_haul),
hb AS (SELECT hu.*, CAST(floor((hu.e - min_e) / 0.6096e0) AS INT) AS bx, CAST(floor((hu.n - min_n) / 0.6096e0) AS INT) AS by_, width, height FROM hu JOIN extents USING (field_id))
"""


def haul_binned(spark, sf) -> DataFrame:
    ext = grid.field_extents(_points(spark, sf))
    return grid.binned(grid.georeferenced(view(spark, sf, "v_haul")), ext).where(grid.in_grid())


def _haul_sql(rest: str) -> str:
    from .base import utm_sql

    e, n = utm_sql("lat", "lon")
    return _HAUL_BINS.format(E=e, N=n) + rest


@query("J08_haul_in_coverage", _haul_sql("SELECT field_id, seq FROM hb WHERE (field_id, bx, by_) IN (SELECT field_id, bx, by_ FROM bins)"), "bins v_haul")
def j08(spark, sf) -> DataFrame:
    return haul_binned(spark, sf).join(bins(spark, sf), KEY, "left_semi").select("field_id", "seq")


@query(
    "A06_haul_vectors",
    _haul_sql(", v AS (SELECT field_id, bx, by_, sum(sin(radians(direction_deg))) AS x, sum(cos(radians(direction_deg))) AS y FROM hb WHERE bx BETWEEN 0 AND width - 1 AND by_ BETWEEN 0 AND height - 1 GROUP BY field_id, bx, by_) SELECT field_id, bx, by_, round(x / sqrt(x * x + y * y), 4) AS vx, round(y / sqrt(x * x + y * y), 4) AS vy FROM v WHERE x * x + y * y > 1e-18"),
    "extents v_haul",
)
def a06(spark, sf) -> DataFrame:
    from ..operators import haul

    return rounded(haul.bin_vectors(haul_binned(spark, sf)))


@query("J12_bins_to_tiles", "SELECT field_id, bx, by_, CAST(floor(bx / 128.0e0) AS INT) AS tile_x, CAST(floor(by_ / 128.0e0) AS INT) AS tile_y FROM bins", "bins")
def j12(spark, sf) -> DataFrame:
    return cover.bins_to_tiles(bins(spark, sf)).select(*KEY, "tile_x", "tile_y")


@query(
    "A20_tile_rollup",
    f"""WITH t AS (SELECT field_id, CAST(floor(bx / 128.0e0) AS INT) AS tile_x, CAST(floor(by_ / 128.0e0) AS INT) AS tile_y, {_BAND} AS band, existing FROM (SELECT *, round(existing - target, 6) AS d FROM bins))
SELECT field_id, tile_x, tile_y, count(*) AS n_bins, count(*) FILTER (band > 4) AS n_cut, count(*) FILTER (band < 4) AS n_fill, count(*) FILTER (band = 4) AS n_grade, round(avg(existing), 4) AS mean_existing FROM t GROUP BY 1, 2, 3""",
    "bins",
)
def a20(spark, sf) -> DataFrame:
    return rounded(tables.tile_rollup(bins(spark, sf).withColumn("band", geo.cut_fill_band(F.round(c("existing") - c("target"), 6)))))


@query("S12_statistics", f"SELECT field_id, {_VOL}, 116.5651e0 AS heading, 0.2236e0 AS slope_pct FROM bins GROUP BY field_id", "bins")
def s12(spark, sf) -> DataFrame:
    return rounded(tables.statistics(bins(spark, sf), 0.2, 0.1, 90.0))


@query(
    "S06_bin_upsert",
    "WITH h AS (SELECT field_id, bx, by_, max(existing) AS existing FROM binned GROUP BY field_id, bx, by_) SELECT field_id, bx, by_, round(existing, 6) AS initial_m, round(CASE WHEN bx % 3 = 0 THEN existing - 0.5e0 ELSE existing END, 6) AS current_m FROM h UNION ALL SELECT field_id, -1 AS bx, by_, 1.0e0 AS initial_m, 2.0e0 AS current_m FROM (SELECT DISTINCT field_id, by_ FROM h WHERE by_ < 40)",
    "binned",
)
def s06u(spark, sf) -> DataFrame:
    """A table of bins; then every third column's heights are updated, which leaves initial heights alone, and a column is inserted."""
    path = f"{shared_dir(spark)}/bins-{uuid.uuid4().hex}"
    points = grid.binned(grid.georeferenced(view(spark, sf, "v_points")))
    cells = points.groupBy(*KEY).agg(F.max("existing").alias("initial_m"), F.max("existing").alias("current_m"))
    tables.upsert_bins(cells, path, 0.25)
    tables.upsert_bins(cells.where("bx % 3 = 0").select(*KEY, (c("current_m") - 0.5).alias("current_m")), path, 0.25)
    tables.upsert_bins(cells.where("by_ < 40").select("field_id", "by_").distinct().select("field_id", F.lit(-1).alias("bx"), "by_", F.lit(1.0).alias("initial_m"), F.lit(2.0).alias("current_m")), path, 0.25)
    return rounded(tables.read_field_state(spark, path, 0.25).select(*KEY, "initial_m", "current_m"), 6)


@query("S06_field_state", "WITH m AS (SELECT field_id, bx, by_, round(existing, 9) AS initial_m, CASE WHEN bx % 9 = 0 THEN NULL ELSE round(existing + 0.05e0, 9) END AS current_m FROM bins) SELECT * FROM m", "bins")
def s06(spark, sf) -> DataFrame:
    cells = bins(spark, sf).select(*KEY, F.round("existing", 9).alias("initial_m"), F.when(c("bx") % 9 != 0, F.round(c("existing") + 0.05, 9)).alias("current_m"))
    return tables.field_state_round_trip(cells)


@query("G23_strip", "WITH x AS (SELECT field_id, unnest(range(width)) AS bx, height FROM extents), g AS (SELECT field_id, bx, unnest(range(height)) AS by_ FROM x) SELECT g.field_id, CAST(g.bx AS INT) AS bx, CAST(g.by_ AS INT) AS by_, round(coalesce(existing, 0) - 0.1e0, 9) AS target FROM g LEFT JOIN bins b ON g.field_id = b.field_id AND g.bx = b.bx AND g.by_ = b.by_", "bins")
def g23(spark, sf) -> DataFrame:
    pts = _points(spark, sf)
    ext = grid.field_extents(pts)
    return rounded(tables.stripped(grid.dense(ext.select("field_id", "width", "height"), grid.bin_means(grid.binned(pts, ext)).select(*KEY, "existing")), 0.1).select(*KEY, "target"), 9)


@query("G12_dem", "SELECT field_id, max(by_) OVER (PARTITION BY field_id) - by_ AS row_, bx AS col, round(existing, 9) AS z FROM bins", "bins")
def g12(spark, sf) -> DataFrame:
    return rounded(tables.dem_cells(bins(spark, sf), "existing").select("field_id", "row_", "col", "z"), 9)


@query("S11_dem_meta", "SELECT field_id, CAST(max(by_) + 1 AS INT) AS nrows, CAST(max(bx) + 1 AS INT) AS ncols, round(min(existing), 9) AS min_z, round(max(existing), 9) AS max_z, -9999.0e0 AS nodata, 0.6096e0 AS pixel FROM bins GROUP BY field_id", "bins")
def s11(spark, sf) -> DataFrame:
    return rounded(tables.dem_meta(bins(spark, sf), "existing"), 9)


@query(
    "S11_dem_placed",
    f"""WITH d AS (SELECT field_id, max(by_) + 1 AS nrows, max(bx) + 1 AS ncols FROM bins GROUP BY field_id)
SELECT field_id, nrows, ncols, 15 AS zone, true AS is_north, round(min_e, 3) AS west_e, round(min_n + nrows * {BIN_M}e0, 3) AS north_n, round(min_e + {BIN_M}e0 / 2, 3) AS first_e, round(min_n + nrows * {BIN_M}e0 - {BIN_M}e0 / 2, 3) AS first_n FROM d JOIN extents USING (field_id)""",
    "bins",
)
def s11p(spark, sf) -> DataFrame:
    pts = grid.georeferenced(view(spark, sf, "v_points"))
    cells = grid.bin_means(grid.binned(pts))
    got = tables.dem_placed(tables.dem_meta(cells, "existing"), grid.field_extents(pts))
    return rounded(got.select("field_id", "nrows", "ncols", "zone", "is_north", "west_e", "north_n", F.element_at("world", 5).alias("first_e"), F.element_at("world", 6).alias("first_n")), 3)
