"""Queries on grid surfaces and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, surface
from .base import query, rounded, view

c = F.col
KEY = grid.KEY
#: A third of the grid is missing; in the tests the rounds are held against one pass in raster order.
_HOLES = "(bx * 7 + by_ * 13) % 10 < 3"


def _holed(spark, sf) -> DataFrame:
    return view(spark, sf, "v_grid").withColumn("z", F.when(~F.expr(_HOLES), c("z")))


def _mask(spark, sf) -> DataFrame:
    return view(spark, sf, "v_grid").where("(bx * 5 + by_ * 3) % 17 < 11").select(*KEY)


_MASK = "m AS (SELECT field_id, bx, by_ FROM v_grid WHERE (bx * 5 + by_ * 3) % 17 < 11)"
_STEPS = "s AS (SELECT a - 1 AS dx, b - 1 AS dy FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b))"


@query("G01_fill_gaps", None)
def g01(spark, sf) -> DataFrame:
    return rounded(surface.fill_gaps(_holed(spark, sf).select(*KEY, "z")), 9)


@query("G02_fill_gaps_8", None)
def g02(spark, sf) -> DataFrame:
    small = _holed(spark, sf).select(*KEY, "z")
    return rounded(surface.fill_gaps_8(small), 9)


@query(
    "J05_neighbours",
    f"WITH {_STEPS} SELECT g.field_id, g.bx, g.by_, count(*) AS n, round(avg(h.z), 6) AS mean_z FROM v_grid g, s, v_grid h WHERE (dx <> 0 OR dy <> 0) AND h.bx = g.bx + dx AND h.by_ = g.by_ + dy GROUP BY g.field_id, g.bx, g.by_",
    "v_grid",
)
def j05(spark, sf) -> DataFrame:
    cells = view(spark, sf, "v_grid")
    seen = grid.neighbours(cells.select(*KEY, c("z").alias("nz")), True, "nz").join(cells.select(*KEY), KEY, "left_semi")
    return rounded(seen.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("nz").alias("mean_z")), 6)


@query("G07_dilate", f"WITH {_MASK}, {_STEPS} SELECT DISTINCT field_id, CAST(bx + dx AS INT) AS bx, CAST(by_ + dy AS INT) AS by_ FROM m, s", "v_grid")
def g07(spark, sf) -> DataFrame:
    return surface.dilated(_mask(spark, sf)).select("field_id", c("bx").cast("int").alias("bx"), c("by_").cast("int").alias("by_"))


_SOLID = "NOT (bx % 7 = 3 AND by_ % 5 = 2)"


@query("G07_erode", f"WITH m AS (SELECT field_id, bx, by_ FROM v_grid WHERE {_SOLID}), {_STEPS} SELECT m.field_id, m.bx, m.by_ FROM m, s, m AS o WHERE o.bx = m.bx + dx AND o.by_ = m.by_ + dy GROUP BY m.field_id, m.bx, m.by_ HAVING count(*) = 9", "v_grid")
def g07e(spark, sf) -> DataFrame:
    return surface.eroded(view(spark, sf, "v_grid").where(_SOLID).select(*KEY))


@query("W09_envelope", f"WITH {_MASK}, r AS (SELECT by_, min(bx) AS lo, max(bx) AS hi FROM m GROUP BY by_), k AS (SELECT bx, min(by_) AS lo, max(by_) AS hi FROM m GROUP BY bx) SELECT DISTINCT g.field_id, g.bx, g.by_ FROM v_grid g LEFT JOIN r ON g.by_ = r.by_ LEFT JOIN k ON g.bx = k.bx WHERE g.bx BETWEEN r.lo AND r.hi OR g.by_ BETWEEN k.lo AND k.hi", "v_grid")
def w09(spark, sf) -> DataFrame:
    return surface.envelope(_mask(spark, sf))


@query(
    "G09_component_sizes",
    """WITH m AS (SELECT bx, by_ FROM v_grid WHERE bx % 9 <> 4) SELECT CAST(bx // 9 * 2 + CASE WHEN bx % 9 > 4 THEN 1 ELSE 0 END AS INT) AS strip, count(*) AS n FROM m GROUP BY 1""",
    "v_grid",
)
def g09s(spark, sf) -> DataFrame:
    """Walls every nine columns leave strips; the last columns of one and the first of the next are one component, so strips are named by both halves."""
    cells = view(spark, sf, "v_grid").where("bx % 9 <> 4").select(*KEY)
    named = surface.labelled(cells)
    same = named.withColumn("strip", F.expr("cast(bx div 9 * 2 + if(bx % 9 > 4, 1, 0) as int)"))
    return same.groupBy("strip").agg(F.count("*").alias("n"))


@query("G09_largest_component", "SELECT field_id, bx, by_ FROM v_grid WHERE bx BETWEEN 5 AND 12", "v_grid")
def g09(spark, sf) -> DataFrame:
    return surface.largest_component(view(spark, sf, "v_grid").where("bx % 9 <> 4").select(*KEY))


@query("G08_fill_holes", "SELECT field_id, bx, by_ FROM v_grid", "v_grid")
def g08(spark, sf) -> DataFrame:
    """Isolated holes inside are filled again."""
    cells = view(spark, sf, "v_grid").where("NOT (bx % 6 = 3 AND by_ % 4 = 1)").select(*KEY)
    return surface.filled_holes(cells).select("field_id", c("bx").cast("int").alias("bx"), c("by_").cast("int").alias("by_"))


@query("G10_observed_mask", None)
def g10(spark, sf) -> DataFrame:
    return surface.observed_mask(_mask(spark, sf))


_BLUR = """WITH r AS (SELECT field_id, bx, by_, (sum(z) OVER (PARTITION BY by_ ORDER BY bx RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - bx) * first_value(z) OVER (PARTITION BY by_ ORDER BY bx) + greatest(0, bx + 3 - max(bx) OVER ()) * last_value(z) OVER (PARTITION BY by_ ORDER BY bx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7 AS z FROM v_grid)
SELECT field_id, bx, by_, round((sum(z) OVER (PARTITION BY bx ORDER BY by_ RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - by_) * first_value(z) OVER (PARTITION BY bx ORDER BY by_) + greatest(0, by_ + 3 - max(by_) OVER ()) * last_value(z) OVER (PARTITION BY bx ORDER BY by_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7, 6) AS z FROM r"""


@query("W06_box_blur", _BLUR, "v_grid")
def w06(spark, sf) -> DataFrame:
    return rounded(surface.box_blur(view(spark, sf, "v_grid"), 3), 6)


_GAUSS = """WITH k AS (SELECT i - 12 AS i, exp(-pow(i - 12, 2) / 18.0e0) AS w FROM (SELECT unnest(range(25)) AS i)), d AS (SELECT bx, by_, z FROM v_grid WHERE NOT ({h})), x AS (SELECT max(bx) AS mx, max(by_) AS my FROM v_grid),
a AS (SELECT d.bx, d.by_, sum(w * o.z) / sum(w) AS z FROM d, x, k, d AS o WHERE o.by_ = d.by_ AND o.bx = greatest(0, least(mx, d.bx + i)) GROUP BY d.bx, d.by_)
SELECT g.field_id, g.bx, g.by_, round(z2, 6) AS z FROM v_grid g LEFT JOIN (SELECT a.bx, a.by_, sum(w * o.z) / sum(w) AS z2 FROM a, x, k, a AS o WHERE o.bx = a.bx AND o.by_ = greatest(0, least(my, a.by_ + i)) GROUP BY a.bx, a.by_) s ON g.bx = s.bx AND g.by_ = s.by_""".format(h=_HOLES)


@query("G11_gaussian", _GAUSS, "v_grid")
def g11(spark, sf) -> DataFrame:
    return rounded(surface.gaussian(_holed(spark, sf)), 6)


def _xy(spark, sf) -> DataFrame:
    return view(spark, sf, "v_grid").withColumn("x", c("bx") * 0.6096).withColumn("y", c("by_") * 0.6096)


_BALANCE = """WITH r AS (SELECT field_id, z + 0.002e0 * bx * 0.6096e0 - 0.001e0 * by_ * 0.6096e0 AS r FROM v_grid), w AS (SELECT field_id, r, sum(r) OVER o AS below, row_number() OVER o AS k, count(*) OVER (PARTITION BY field_id) AS n, sum(r) OVER (PARTITION BY field_id) AS s, lead(r) OVER o AS nxt FROM r WINDOW o AS (PARTITION BY field_id ORDER BY r ROWS UNBOUNDED PRECEDING)),
c AS (SELECT field_id, k, ((s - below) + 1.2e0 * below) / ((n - k) + 1.2e0 * k) AS c, r, nxt FROM w) SELECT field_id, round(c, 5) AS c FROM c WHERE c >= r AND c < nxt"""


@query("G22_balanced_plane", _BALANCE, "v_grid")
def g22(spark, sf) -> DataFrame:
    return rounded(surface.balanced_plane(_xy(spark, sf), -0.002, 0.001), 5)


@query(
    "W11_balance_residual",
    _BALANCE.replace("SELECT field_id, round(c, 5) AS c FROM c WHERE c >= r AND c < nxt", ", p AS (SELECT field_id, c FROM c WHERE c >= r AND c < nxt), d AS (SELECT g.field_id, z + 0.002e0 * bx * 0.6096e0 - 0.001e0 * by_ * 0.6096e0 - c AS d FROM v_grid g JOIN p ON g.field_id = p.field_id) SELECT field_id, round(sum(greatest(d, 0)) * 0.37161216e0, 3) AS cut_m3, round(sum(greatest(-d, 0)) * 0.37161216e0, 3) AS fill_m3 FROM d GROUP BY field_id"),
    "v_grid",
)
def w11(spark, sf) -> DataFrame:
    """Cut and fill at the balance that prefix sums find."""
    cells = _xy(spark, sf)
    return rounded(surface.plane_volumes(cells, surface.balanced_plane(cells, -0.002, 0.001), -0.002, 0.001), 3)


@query("G06_warp_tolerance", None)
def g06(spark, sf) -> DataFrame:
    """The warped surface lies within the tolerance of what was observed."""
    cells = view(spark, sf, "v_grid")
    seen = cells.where("(bx + by_) % 5 = 0").select(*KEY, (c("z") + 0.02).alias("seen"))
    got = surface.warped(cells, seen).join(seen, KEY)
    return got.groupBy("field_id").agg((F.max(F.abs(c("z") - c("seen"))) <= 0.009 + 1e-9).alias("near"))
