"""Loops against plain sequential versions on a small grid with holes."""

import heapq

import numpy as np
import pytest

from loamgrid.constants import AROUND
from loamgrid.operators import clean, drainage, haul, surface

W, H = 12, 9


@pytest.fixture(scope="module")
def z():
    rng = np.random.default_rng(1)
    z = np.round(30 + rng.random((H, W)), 3)
    z[3:5, 4:6] = np.nan
    return z


def frame(spark, z):
    return spark.createDataFrame([(0, x, y, None if np.isnan(z[y, x]) else float(z[y, x])) for y in range(H) for x in range(W)], "field_id int, bx int, by_ int, z double").cache()


def matrix(df, column="z"):
    g = np.full((H, W), np.nan)
    for r in df.toPandas().itertuples():
        v = getattr(r, column)
        g[r.by_, r.bx] = np.nan if v is None else v
    return g


def test_depressions_as_by_a_queue(spark, z):
    best, heap = np.full(z.shape, np.inf), []
    for y in range(H):
        for x in range(W):
            if not np.isnan(z[y, x]) and (x in (0, W - 1) or y in (0, H - 1)):
                best[y, x] = z[y, x]
                heap.append((z[y, x], y, x))
    heapq.heapify(heap)
    while heap:
        h, y, x = heapq.heappop(heap)
        for dx, dy in AROUND:
            a, b = x + dx, y + dy
            if 0 <= a < W and 0 <= b < H and not np.isnan(z[b, a]) and max(h, z[b, a]) < best[b, a]:
                best[b, a] = max(h, z[b, a])
                heapq.heappush(heap, (best[b, a], b, a))
    best[np.isinf(best)] = z[np.isinf(best)]
    assert np.allclose(matrix(drainage.filled(frame(spark, z), 5), "filled"), best, equal_nan=True)


def test_gap_fills_as_in_raster_order(spark, z):
    m = z.copy()
    m[np.random.default_rng(2).random(z.shape) < 0.35] = np.nan
    four, eight, given = m.copy(), m.copy(), ~np.isnan(m)
    inside = lambda a, b: 0 <= a < W and 0 <= b < H
    for y in range(H):
        for x in range(W):
            if not given[y, x]:
                around = [(x, y - 1), (x - 1, y), (x + 1, y), (x, y + 1)]
                if sum(inside(a, b) and given[b, a] for a, b in around) >= 2:
                    v = [four[b, a] for a, b in around if inside(a, b) and (given[b, a] or b < y or a < x) and not np.isnan(four[b, a])]
                    four[y, x] = np.mean(v)
                v = [eight[y + dy, x + dx] for dx, dy in AROUND if inside(x + dx, y + dy) and not np.isnan(eight[y + dy, x + dx])]
                if len(v) >= 4:
                    eight[y, x] = np.mean(v)
    assert np.allclose(matrix(surface.fill_gaps(frame(spark, m))), four, equal_nan=True)
    assert np.allclose(matrix(surface.fill_gaps_8(frame(spark, m), block=4)), eight, equal_nan=True)


def test_ponds_keep_all_water(spark, z):
    ponds, sinks = drainage.ponding(frame(spark, z), 0.03, 1.0, 6)
    s = sinks.toPandas()
    assert abs(s.inflow.sum() - s.stored.sum() - s.lost.sum()) < 1e-9 and abs(ponds.toPandas().pond.sum() - s.stored.sum()) < 1e-9


def test_routes_as_walked(spark):
    rng = np.random.default_rng(4)
    hd = spark.createDataFrame([(0, x, y, float(rng.integers(0, 360))) for y in range(H) for x in range(W)], "field_id int, bx int, by_ int, heading_deg double").cache()
    nxt = haul.successors(hd).cache()
    step = {(r.bx, r.by_): (r.nx, r.ny) for r in nxt.toPandas().itertuples()}
    for r in haul.routes(hd.selectExpr("field_id", "by_ * 100 + bx AS path_id", "bx", "by_"), nxt).toPandas().itertuples():
        path = [(r.path_id % 100, r.path_id // 100)]
        while path[-1] in step and step[path[-1]] not in path:
            path.append(step[path[-1]])
        assert [tuple(p) for p in r.route] == path


def test_near_dots_and_spikes(spark):
    dots = spark.createDataFrame([(0, i, i * 0.2, 0.0) for i in range(1, 6)], "field_id int, seq int, x double, y double")
    assert sorted(r.seq for r in clean.without_near_dots(dots, 0.3048).collect()) == [1, 3, 5]
    pts = [(1, "interior", i, i * 2.0, 0.0, 30.0) for i in range(8)]
    pts[4] = (1, "interior", 4, 8.0, 0.0, 28.9)
    kept = clean.without_spikes(spark.createDataFrame(pts, "survey_id long, kind string, seq long, x double, y double, z double"))
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_neighbours_are_not_broadcast(spark, tmp_path):
    """Tables whose files are small but whose neighbours are not: joins of cells with what is around them never build on the driver."""
    spark.range(5000).selectExpr("0 AS field_id", "CAST(id % 50 AS INT) AS bx", "CAST(id DIV 50 AS INT) AS by_", "CAST(id * 7919 % 997 AS DOUBLE) AS z").write.parquet(f"{tmp_path}/dem")
    dem = spark.read.parquet(f"{tmp_path}/dem")
    flow = drainage.receivers(dem)
    for df in (flow, drainage.d_infinity(dem), drainage.runoff_accumulated(flow), drainage.terminals(flow)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
