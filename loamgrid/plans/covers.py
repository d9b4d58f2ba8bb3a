"""Queries on covering joins, nearest neighbours and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BIN_M
from ..operators import cover, gnss, grid, nearest, surface
from .base import bins, query, rounded, utm_sql, view

c = F.col
_E, _N = utm_sql("lat", "lon")


def _squares(spark, sf) -> DataFrame:
    """A rotated square of each haul sample's own size, in metres from a corner."""
    h = view(spark, sf, "v_haul")
    x, y, r = (c("seq") % 97) * 1.0 + 10, (c("seq") % 61) * 1.0 + 10, (c("seq") % 5) * 0.4 + 0.9
    point = lambda a, b: F.struct((x + a * r).alias("x"), (y + b * r).alias("y"))
    return h.select("seq", r.alias("r"), F.array(point(0.8, -0.6), point(0.6, 0.8), point(-0.8, 0.6), point(-0.6, -0.8)).alias("ring"))


@query("J02_polygon_areas", "SELECT c_custkey AS seq, round(2 * pow((c_custkey % 5) * 0.4e0 + 0.9e0, 2), 4) AS area_m2 FROM customer")
def j02(spark, sf) -> DataFrame:
    """Clipped areas over all bins add up to the polygon's."""
    got = cover.polygon_bins(_squares(spark, sf), BIN_M, 0.0, "seq")
    return rounded(got.groupBy("seq").agg(F.sum("area_m2").alias("area_m2")))


@query("F10_min_coverage", None)
def f10(spark, sf) -> DataFrame:
    return rounded(cover.polygon_bins(_squares(spark, sf), BIN_M, 0.3, "seq"), 6)


_ROUTE = "WITH l AS (SELECT bx, by_, bx + 17 AS x1, by_ + (bx % 7) AS y1, greatest(17, bx % 7) AS n FROM v_grid), k AS (SELECT *, unnest(range(n + 1)) AS k FROM l) SELECT bx AS x0, by_ AS y0, CAST(k AS INT) AS k, CAST(floor(bx + 17.0e0 * k / n + 0.5e0) AS INT) AS bx, CAST(floor(by_ + (bx % 7) * 1.0e0 * k / n + 0.5e0) AS INT) AS by_ FROM k"


@query("J16_bins_between", _ROUTE, "v_grid")
def j16(spark, sf) -> DataFrame:
    lines = view(spark, sf, "v_grid").select(c("bx").alias("x0"), c("by_").alias("y0"), (c("bx") + 17).alias("x1"), (c("by_") + c("bx") % 7).alias("y1"))
    return cover.bins_between(lines).select("x0", "y0", "k", "bx", "by_")


#: A ring about each field's grid cells: an octagon.
_RING = [(5, 2), (35, 2), (45, 10), (45, 30), (35, 38), (12, 38), (3, 30), (3, 10)]
_EDGES = " UNION ALL ".join(f"SELECT {x1}.0e0 AS x1, {y1}.0e0 AS y1, {x2}.0e0 AS x2, {y2}.0e0 AS y2" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query(
    "J13_in_ring",
    f"""WITH e AS ({_EDGES}), g AS (SELECT bx, by_, CAST(bx AS DOUBLE) AS x, CAST(by_ AS DOUBLE) AS y FROM v_grid),
m AS (SELECT bx, by_, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x THEN 1 ELSE 0 END) AS n,
  max(CASE WHEN abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) AS edge FROM g, e GROUP BY bx, by_)
SELECT bx, by_ FROM m WHERE n % 2 = 1 OR edge = 1""",
    "v_grid",
)
def j13(spark, sf) -> DataFrame:
    cells = view(spark, sf, "v_grid").select("field_id", "bx", "by_", c("bx").cast("double").alias("x"), c("by_").cast("double").alias("y"))
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True)]) for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True)])
    ring = cells.select("field_id").distinct().select("field_id", F.explode(edges).alias("e")).select("field_id", "e.*")
    return cover.in_rings(cells, ring).select("bx", "by_")


@query(
    "T07_ring_order",
    f"""WITH b AS (SELECT field_id, seq, {_E} AS x, {_N} AS y FROM v_haul), m AS (SELECT *, avg(x) OVER (PARTITION BY field_id) AS mx, avg(y) OVER (PARTITION BY field_id) AS my FROM b),
o AS (SELECT *, row_number() OVER s AS k1, row_number() OVER a AS k2, coalesce(lead(x) OVER s, first_value(x) OVER s) AS x1, coalesce(lead(y) OVER s, first_value(y) OVER s) AS y1, coalesce(lead(x) OVER a, first_value(x) OVER a) AS x2, coalesce(lead(y) OVER a, first_value(y) OVER a) AS y2 FROM m
  WINDOW s AS (PARTITION BY field_id ORDER BY seq), a AS (PARTITION BY field_id ORDER BY atan2(y - my, x - mx), seq)),
t AS (SELECT *, sum(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2))) OVER (PARTITION BY field_id) AS l1, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) OVER (PARTITION BY field_id) AS l2 FROM o)
SELECT field_id, seq, CASE WHEN l2 < l1 THEN k2 ELSE k1 END AS place FROM t""",
    "v_haul",
)
def t07(spark, sf) -> DataFrame:
    dots = grid.georeferenced(view(spark, sf, "v_haul")).select("field_id", "seq", c("e").alias("x"), c("n").alias("y"))
    return cover.ring_order(dots).select("field_id", "seq", "place")


_NEAREST = f"""WITH p AS (SELECT field_id, seq, existing, {_E} AS e, {_N} AS n FROM v_points), m AS (SELECT field_id, name, elevation_m, {_E} AS me, {_N} AS mn FROM v_benchmarks),
d AS (SELECT p.*, name, round(me - e, 3) AS de, round(mn - n, 3) AS dn, round(elevation_m - existing, 9) AS dh, row_number() OVER (PARTITION BY p.field_id, seq, existing ORDER BY pow(me - e, 2) + pow(mn - n, 2), name) AS k FROM p JOIN m USING (field_id))
SELECT field_id, seq, name AS benchmark, de, dn, dh FROM d WHERE k = 1"""


@query("J03_nearest_benchmark", _NEAREST, "v_points v_benchmarks")
def j03(spark, sf) -> DataFrame:
    pts = grid.georeferenced(view(spark, sf, "v_points")).withColumn("elevation_m", c("existing"))
    got = gnss.nearest_benchmark(pts, grid.georeferenced(view(spark, sf, "v_benchmarks")))
    return got.select("field_id", "seq", "benchmark", F.round("de", 3).alias("de"), F.round("dn", 3).alias("dn"), F.round("dh", 9).alias("dh"))


@query("T09_nearest_one", _NEAREST.replace("SELECT field_id, seq, name AS benchmark, de, dn, dh FROM d", "SELECT field_id, seq, name AS benchmark FROM d"), "v_points v_benchmarks")
def t09(spark, sf) -> DataFrame:
    pts = grid.georeferenced(view(spark, sf, "v_points")).withColumn("elevation_m", c("existing"))
    return gnss.nearest_benchmark(pts, grid.georeferenced(view(spark, sf, "v_benchmarks"))).select("field_id", "seq", "benchmark")


def knn_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All cells, nine tenths of them far off the points at larger scales, against all points."""
    cells = view(spark, sf, "v_grid").select("field_id", "bx", "by_", (c("bx") * 2.0).alias("x"), (c("by_") * 1.5).alias("y"))
    dots = view(spark, sf, "v_haul").select(F.lit(0).alias("field_id"), "seq", ((c("seq") * 37) % 1009 / 10.0).alias("x"), ((c("seq") * 53) % 613 / 10.0).alias("y"), (30 + (c("seq") % 11) * 0.05).alias("z"))
    return cells, dots


_KNN = """WITH g AS (SELECT bx, by_, bx * 2.0e0 AS x, by_ * 1.5e0 AS y FROM v_grid), p AS (SELECT seq, ((seq * 37) % 1009) / 10.0e0 AS px, ((seq * 53) % 613) / 10.0e0 AS py, 30 + (seq % 11) * 0.05e0 AS z FROM v_haul),
d AS (SELECT bx, by_, x, y, seq, px, py, z, pow(px - x, 2) + pow(py - y, 2) AS d2, row_number() OVER (PARTITION BY bx, by_ ORDER BY pow(px - x, 2) + pow(py - y, 2), seq) AS place FROM g, p)
"""


@query("J04_nearest_64", _KNN + "SELECT bx, by_, seq, place FROM d WHERE place <= 64", "v_grid v_haul")
def j04(spark, sf) -> DataFrame:
    cells, dots = knn_inputs(spark, sf)
    return nearest.nearest_points(cells, dots).select("bx", "by_", "seq", c("place").cast("long").alias("place"))


@query("T08_smallest_distances", _KNN + "SELECT bx, by_, round(max(d2), 6) AS far2 FROM d WHERE place <= 64 GROUP BY bx, by_", "v_grid v_haul")
def t08(spark, sf) -> DataFrame:
    cells, dots = knn_inputs(spark, sf)
    return rounded(nearest.nearest_points(cells, dots).groupBy("bx", "by_").agg(F.max("d2").alias("far2")), 6)


@query(
    "G05_local_planes",
    _KNN + """, k AS (SELECT *, px - x AS dx, py - y AS dy, 1 / (d2 + 0.5625e0 * max(d2) OVER (PARTITION BY bx, by_) + 1e-12) AS w FROM d WHERE place <= 64),
m AS (SELECT bx, by_, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) AS syy, sum(w * z) AS sz, sum(w * dx * z) AS sxz, sum(w * dy * z) AS syz FROM k GROUP BY bx, by_),
r AS (SELECT *, greatest(1e-12, 5e-6 * (s + sxx + syy) / 3) AS l FROM m), q AS (SELECT *, sxx + l AS a, syy + l AS b, s + l AS d FROM r)
SELECT bx, by_, round((a * (b * sz - syz * sy) - sxy * (sxy * sz - syz * sx) + sxz * (sxy * sy - b * sx)) / (a * (b * d - sy * sy) - sxy * (sxy * d - sy * sx) + sx * (sxy * sy - b * sx)), 6) AS z FROM q""",
    "v_grid v_haul",
)
def g05(spark, sf) -> DataFrame:
    cells, dots = knn_inputs(spark, sf)
    return rounded(surface.design_surface(cells, dots).select("bx", "by_", "z"), 6)


#: Heights are whole eighths of a millimetre and tenths of a millimetre, so their sums are exact in both engines.
_EXACT = """WITH w AS (SELECT field_id, seq, bx, by_, CAST(floor(existing * 8000 + 0.5e0) AS BIGINT) AS z8, CAST(floor(target * 10000 + 0.5e0) AS BIGINT) AS t10, width, height FROM binned),
b AS (SELECT field_id, bx, by_, floor(1.0e0 * sum(z8) / count(*) / 8000 * 1e6 + 0.5e0) / 1e6 AS z, floor(1.0e0 * sum(t10) / count(*) / 10000 * 1e6 + 0.5e0) / 1e6 AS t FROM w WHERE bx < width AND by_ < height AND bx % 4 <> 0 GROUP BY field_id, bx, by_)
"""


@query(
    "J15_set_points",
    _EXACT + """SELECT w.field_id, seq, CASE WHEN z IS NULL THEN 0.3e0 WHEN abs(z - t) <= 0.01 THEN 0.0e0 ELSE floor(greatest(-0.1e0, least(0.05e0, t - z)) * 1e6 + 0.5e0) / 1e6 END AS blade_m
FROM w LEFT JOIN b ON w.field_id = b.field_id AND w.bx = b.bx AND w.by_ = b.by_""",
    "binned",
)
def j15(spark, sf) -> DataFrame:
    pts = grid.binned(grid.georeferenced(view(spark, sf, "v_points")))
    whole = lambda x, k: F.floor(c(x) * k + 0.5)
    half_up = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    sums = pts.where(grid.in_grid() & (c("bx") % 4 != 0)).groupBy(*grid.KEY).agg(F.sum(whole("existing", 8000)).alias("z8"), F.sum(whole("target", 10000)).alias("t10"), F.count("*").alias("n"))
    cells = sums.select(*grid.KEY, half_up(c("z8").cast("double") / c("n") / 8000).alias("z"), half_up(c("t10").cast("double") / c("n") / 10000).alias("t"))
    got = pts.select("field_id", "seq", "bx", "by_").join(cells, grid.KEY, "left")
    return got.select("field_id", "seq", half_up(set_point(c("z"), c("t"), 0.3, 0.1, 0.05)).alias("blade_m"))


def set_point(z, target, transport: float, most_cut: float, most_fill: float):
    """Blade height over ground: transport height without data, 0 at grade, else to target within the most cut and fill."""
    return F.when(z.isNull() | target.isNull(), transport).when(F.abs(z - target) <= 0.01, 0.0).otherwise(F.greatest(F.lit(-most_cut), F.least(F.lit(most_fill), target - z)))


_CUTS = "WITH k AS (SELECT field_id, bx, by_ FROM bins WHERE existing > target)"


@query("W10_raster_numbers", _CUTS + " SELECT *, CAST(row_number() OVER (PARTITION BY field_id ORDER BY by_, bx) AS INT) AS path_id FROM k", "bins")
def w10(spark, sf) -> DataFrame:
    from ..operators import tables

    return tables.place_in_raster(bins(spark, sf).where("existing > target").select(*grid.KEY), "path_id").select(*grid.KEY, "path_id")


#: Cut bins of every third column own a path.
_OWNED = "bx % 3 = 1"


@query("F06_random_bins", _CUTS + f" SELECT field_id, bx, by_ FROM k WHERE {_OWNED} ORDER BY md5('s:' || field_id || ':' || bx || ':' || by_) LIMIT 25", "bins")
def f06(spark, sf) -> DataFrame:
    from ..operators import haul

    cuts = bins(spark, sf).where("existing > target").select(*grid.KEY)
    return haul.sample_with_paths(cuts, view(spark, sf, "v_op_bins").select("field_id").distinct().join(cuts.where(_OWNED), "field_id"), 25)


@query("T05_random_n", "SELECT field_id, bx, by_ FROM v_grid ORDER BY md5('t:' || field_id || ':' || bx || ':' || by_) LIMIT 50", "v_grid")
def t05(spark, sf) -> DataFrame:
    from ..operators import haul

    cells = view(spark, sf, "v_grid").select(*grid.KEY)
    return haul.sample_with_paths(cells, cells, 50, "t")


@query("T03_sorted_export", "SELECT field_id, bx, by_, row_number() OVER (PARTITION BY field_id ORDER BY bx, by_) AS place FROM v_grid", "v_grid")
def t03(spark, sf) -> DataFrame:
    from ..operators import tables

    return tables.place_in_raster(view(spark, sf, "v_grid").select(*grid.KEY), "place", "bx", "by_").select(*grid.KEY, "place")
