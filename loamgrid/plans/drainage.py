"""Queries on drainage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drainage, grid
from .base import query, rounded, view

c = F.col
KEY = grid.KEY


def _dem(spark, sf) -> DataFrame:
    return view(spark, sf, "v_grid")


def _depths(spark, sf) -> DataFrame:
    return drainage.sink_depths(_dem(spark, sf))


def _model(spark, sf) -> tuple[DataFrame, DataFrame]:
    return drainage.ponding(_dem(spark, sf), 0.02, 0.6096)


@query("G13_fill_depressions", None)
def g13(spark, sf) -> DataFrame:
    return rounded(_depths(spark, sf).select(*KEY, "filled", "depth"), 9)


@query("G13_never_below", None)
def g13i(spark, sf) -> DataFrame:
    return _depths(spark, sf).agg(F.count("*").alias("n"), F.min(c("filled") >= c("z")).alias("above"))


_D8 = """WITH o AS (SELECT * FROM (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)) t(k, dx, dy)), d AS (SELECT * FROM v_grid),
s AS (SELECT a.field_id, a.bx, a.by_, k, b.bx AS rx, b.by_ AS ry, (a.z - b.z) / CASE WHEN dx <> 0 AND dy <> 0 THEN sqrt(2.0e0) ELSE 1.0e0 END AS slope FROM d a, o, d b WHERE b.bx = a.bx + dx AND b.by_ = a.by_ + dy),
r AS (SELECT *, row_number() OVER (PARTITION BY bx, by_ ORDER BY slope DESC, k) AS p FROM s WHERE slope > 0), f AS (SELECT d.field_id, d.bx, d.by_, rx, ry FROM d LEFT JOIN r ON d.bx = r.bx AND d.by_ = r.by_ AND p = 1)
"""


@query("G14_receivers", _D8 + "SELECT * FROM f", "v_grid")
def g14(spark, sf) -> DataFrame:
    return drainage.receivers(_dem(spark, sf)).select(*KEY, "rx", "ry")


_WALK = _D8 + ", t AS (SELECT bx, by_, bx AS tx, by_ AS ty, 0 AS n FROM f UNION ALL SELECT t.bx, t.by_, f.rx, f.ry, n + 1 FROM t JOIN f ON f.bx = t.tx AND f.by_ = t.ty WHERE f.rx IS NOT NULL)\n"


@query("G15_terminals", _WALK + "SELECT 0 AS field_id, bx, by_, max_by(tx, n) AS tx, max_by(ty, n) AS ty FROM t GROUP BY bx, by_", "v_grid")
def g15(spark, sf) -> DataFrame:
    return drainage.terminals(drainage.receivers(_dem(spark, sf)))


@query("G15b_accumulated", _WALK + "SELECT 0 AS field_id, tx AS bx, ty AS by_, CAST(count(*) AS DOUBLE) AS flow FROM t GROUP BY tx, ty", "v_grid")
def g15b(spark, sf) -> DataFrame:
    return drainage.runoff_accumulated(drainage.receivers(_dem(spark, sf)))


@query("G16_sink_regions", None)
def g16(spark, sf) -> DataFrame:
    return rounded(drainage.sink_regions(_depths(spark, sf)), 9)


@query("G17_spills", None)
def g17(spark, sf) -> DataFrame:
    return rounded(_model(spark, sf)[1].select("field_id", "sink", "spill", "downstream", "n_cells", "capacity"), 6)


@query("A19_sink_capacity", None)
def a19(spark, sf) -> DataFrame:
    return rounded(_model(spark, sf)[1].select("field_id", "sink", "capacity", "inflow"), 6)


@query("T06_sinks_by_spill", None)
def t06(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    return rounded(_model(spark, sf)[1].select("field_id", "sink", "spill", F.row_number().over(Window.partitionBy("field_id").orderBy("spill", "sink")).alias("turn")), 6)


@query("G18_cascade_balance", None)
def g18(spark, sf) -> DataFrame:
    """What runs into sinks is stored or lost."""
    rows = _model(spark, sf)[1]
    return rows.groupBy("field_id").agg((F.abs(F.sum("inflow") - F.sum("stored") - F.sum("lost")) < 1e-6).alias("balanced"))


@query("G19_pond_volumes", None)
def g19(spark, sf) -> DataFrame:
    """Ponds hold what their sinks store (W12: the level comes from prefix sums)."""
    ponds, rows = _model(spark, sf)
    held = ponds.groupBy("field_id", "sink").agg((F.sum("pond") * 0.6096**2).alias("held"))
    return rows.join(held, ["field_id", "sink"]).groupBy("field_id").agg((F.max(F.abs(c("held") - c("stored"))) < 1e-9).alias("equal_"))


@query("W12_pond_levels", None)
def w12(spark, sf) -> DataFrame:
    depths = _depths(spark, sf)
    regions = drainage.sink_regions(depths)
    half = regions.groupBy("field_id", "sink").agg((F.sum("depth") * 0.5 * 0.6096**2).alias("stored"))
    return rounded(drainage.pond_levels(regions, half, 0.6096**2), 6)


@query("G20_ponding", None)
def g20(spark, sf) -> DataFrame:
    return rounded(_model(spark, sf)[0], 6)


@query("G21_flow_balance", None)
def g21b(spark, sf) -> DataFrame:
    return drainage.flow_cells(_dem(spark, sf)).groupBy("field_id").agg(F.count("*").alias("n"), (F.min("flow") >= 1 - 1e-9).alias("at_least_own"))


@query("G21_flow_cells", None)
def g21(spark, sf) -> DataFrame:
    return rounded(drainage.flow_cells(_dem(spark, sf)))
