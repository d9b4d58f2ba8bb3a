"""Rules whose order is their meaning, against plain sequential versions on made-up cases."""

import math
from collections import Counter

import numpy as np
import pytest

from loamgrid.constants import AROUND, MASTER_ELEVATION_M
from loamgrid.operators import clean, drainage, haul, ledger, surface
from loamgrid.plans import catalog
from loamgrid.streaming import live


def test_near_dots_in_order(spark):
    """A chain far longer than a block, and random dots of two fields."""
    rng = np.random.default_rng(3)
    dots = [(0, i, i * 0.2, 0.0) for i in range(300)] + [(f, int(k), float(x), float(y)) for f in (1, 2) for k, (x, y) in enumerate(rng.random((900, 2)) * 40)]
    want = set()
    for field in (0, 1, 2):
        kept = []
        for _, seq, x, y in (d for d in dots if d[0] == field):
            if all((x - a) ** 2 + (y - b) ** 2 >= 0.3048**2 for a, b in kept):
                kept.append((x, y))
                want.add((field, seq))
    got = clean.without_near_dots(spark.createDataFrame(dots, "field_id int, seq long, x double, y double"), 0.3048)
    assert {(r.field_id, r.seq) for r in got.collect()} == want and (0, 298) in want and (0, 1) not in want


def plain_pruned(points):
    """The rules of runs and spikes after each point, written out with indexes."""
    p = []

    def dist(a, b):
        return math.hypot(b[0] - a[0], b[1] - a[1])

    def low(anchor, end, k):
        length = dist(p[anchor], p[end])
        return length >= 0.5 and p[k][2] < p[anchor][2] + dist(p[anchor], p[k]) / length * (p[end][2] - p[anchor][2]) - 0.3048

    def run():
        end = len(p) - 1
        if end < 2:
            return False
        d, rise = dist(p[end - 1], p[end]), p[end][2] - p[end - 1][2]
        if d < 0.5 or rise < 0.6096 or rise / d < 0.12:
            return False
        starts = [s for s in range(max(1, end - 12), end) if all(low(s - 1, end, k) for k in range(s, end))]
        if not starts:
            return False
        s = starts[-1]
        while s > 1 and low(s - 2, end, s - 1):
            s -= 1
        del p[s:end]
        return True

    def spike():
        if len(p) < 3:
            return False
        a, m, b = p[-3:]
        d1, d2 = dist(a, m), dist(m, b)
        for sign in (1, -1):
            if sign * (m[2] - a[2]) >= 0.6096 and sign * (m[2] - b[2]) >= 0.6096 and min(d1, d2) >= 0.5 and sign * (m[2] - a[2]) / d1 > 0.08 and sign * (m[2] - b[2]) / d2 > 0.08:
                del p[-2]
                return True
        return False

    for q in points:
        p.append(q)
        while run() or spike():
            pass
    return p


def lines(n):
    """Survey lines with spikes, short and long low runs, and very close points."""
    rng = np.random.default_rng(8)
    for k in range(n):
        x, z = np.cumsum(rng.choice([0.2, 1.0, 3.0, 4.0], 80)), 30 + rng.normal(0, 0.05, 80)
        for _ in range(4):
            at, size = rng.integers(2, 70), rng.integers(1, 18)
            z[at : at + size] += rng.choice([-2.0, -1.0, -0.5, 1.2]) - rng.choice([0, 0.2]) * np.arange(len(z[at : at + size]))
        yield k, x, z


def test_spikes_and_runs(spark):
    rows, want = [], set()
    for k, x, z in lines(40):
        pts = [(float(a), 0.0, float(b), i) for i, (a, b) in enumerate(zip(x, z, strict=True))]
        rows += [(k, "interior", i, a, b, h) for a, b, h, i in pts]
        want |= {(k, q[3]) for q in plain_pruned(pts)}
    got = clean.without_spikes(spark.createDataFrame(rows, "survey_id long, kind string, seq long, x double, y double, z double"))
    assert {(r.survey_id, r.seq) for r in got.collect()} == want and len(want) < len(rows) - 200


def test_survey_capture_as_a_stream(spark):
    """Both sides, spacing from the point as recorded, heights relative to the master, pruning, in several micro-batches."""
    fixes, want = [], {}
    for k, x, z in lines(6):
        for kind in ("boundary", "interior"):
            side, master = ("left", "right")[k % 2], None if k == 5 else 20.0
            mine = []
            for i in range(len(x)):
                heading, state = float((i * 7) % 360), ("Stable", "HighQuality", "Unstable")[i % 3]
                fixes.append((k, kind, side, i, float(x[i]), 0.0, float(z[i]), heading, state, master))
                if master is None or state == "Unstable" or (mine and math.hypot(x[i] - mine[-1][0], -mine[-1][1]) <= 3.048):
                    continue
                turn = math.radians(heading + (-90 if side == "left" else 90))
                aside = 1.5 if kind == "boundary" else 0.0
                mine = plain_pruned([*mine, (x[i] + math.sin(turn) * aside, math.cos(turn) * aside, z[i] - 20.0 + MASTER_ELEVATION_M, i)])
            want |= {(k, kind, q[3]): q[:3] for q in mine}
    rows = spark.createDataFrame(fixes, "survey_id long, kind string, side string, seq long, x double, y double, z double, heading_deg double, state string, master_m double")
    for log in (live.survey_capture(rows), live.replayed(rows, "seq", live.survey_capture, 3)):
        got = {(r.survey_id, r.kind, r.seq): (r.x, r.y, r.z) for r in live.standing_points(log).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.fixture(scope="module")
def fields():
    """Two rough fields of different size."""
    rng = np.random.default_rng(5)
    return {0: np.round(30 + rng.random((23, 17)), 3), 4: np.round(10 + rng.random((9, 31)), 3)}


def frame(spark, fields):
    rows = [(f, x, y, float(z[y, x])) for f, z in fields.items() for y in range(z.shape[0]) for x in range(z.shape[1])]
    return spark.createDataFrame(rows, "field_id int, bx int, by_ int, z double").cache()


def around(z, x, y):
    return [(x + dx, y + dy) for dx, dy in AROUND if 0 <= x + dx < z.shape[1] and 0 <= y + dy < z.shape[0]]


def test_depressions_of_two_fields_over_block_edges(spark, fields):
    want = {}
    for f, z in fields.items():
        level = np.where(np.pad(np.zeros(np.array(z.shape) - 2, bool), 1, constant_values=True), z, np.inf)
        moved = True
        while moved:
            moved = False
            for y in range(z.shape[0]):
                for x in range(z.shape[1]):
                    low = max(z[y, x], min(level[b, a] for a, b in around(z, x, y)))
                    if low < level[y, x]:
                        level[y, x], moved = low, True
        want |= {(f, x, y): level[y, x] for y in range(z.shape[0]) for x in range(z.shape[1])}
    got = {(r.field_id, r.bx, r.by_): r.filled for r in drainage.filled(frame(spark, fields), 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_serpentine_valley_in_fixed_passes(spark, monkeypatch):
    """A valley that winds through ten by ten blocks and across two growths of them drains in as many passes as a flat field."""
    n, size = 50, 5
    z = np.full((n, n), 9.0)
    for k in range(1, n - 1, 4):
        z[k, 1 : n - 1] = 1.0
        if k + 4 < n - 1:
            z[k : k + 4, n - 2 if (k // 4) % 2 == 0 else 1] = 1.0
    z[1, 25], z[45, 10] = 0.0, 0.25
    z[1, 0] = 2.0
    passes = []
    cut = drainage.cut
    monkeypatch.setattr(drainage, "cut", lambda df: passes.append(1) or cut(df))
    monkeypatch.setattr(drainage, "GROWTH", 3)
    counts = []
    for surface_ in (z, np.full((n, n), 3.0)):
        passes.clear()
        rows = [(3, x, y, float(surface_[y, x])) for y in range(n) for x in range(n)]
        got = drainage.filled(spark.createDataFrame(rows, "field_id int, bx int, by_ int, z double"), size).collect()
        counts.append(len(passes))
        if surface_ is z:
            assert all(r.filled == (9.0 if r.z == 9.0 else 2.0) for r in got) and len(got) == n * n
    assert counts[0] == counts[1] < 20


def test_ponding_model_of_two_fields(spark, fields):
    """Regions, capacities, inflows, spills, downstream sinks, cascade and ponds against the same steps cell by cell."""
    cell, rain = 0.25, 0.05
    ponds, sinks = drainage.ponding(frame(spark, fields), rain, 0.5, 5)
    got_sinks = {(r.field_id, r.sink): r for r in sinks.collect()}
    got_ponds = {(r.field_id, r.bx, r.by_): r.pond for r in ponds.collect()}
    want_ponds = {}
    for f, z in fields.items():
        h, w = z.shape
        level = np.where(np.pad(np.zeros((h - 2, w - 2), bool), 1, constant_values=True), z, np.inf)
        while True:
            new = np.array([[max(z[y, x], min([level[y, x], *(level[b, a] for a, b in around(z, x, y))])) for x in range(w)] for y in range(h)])
            new = np.minimum(new, level)
            if (new == level).all():
                break
            level = new
        sink_of, n = {}, 0
        for y in range(h):
            for x in range(w):
                if level[y, x] > z[y, x] and (x, y) not in sink_of:
                    n += 1
                    sink_of[x, y], todo = n, [(x, y)]
                    while todo:
                        for p in around(z, *todo.pop()):
                            if level[p[1], p[0]] > z[p[1], p[0]] and p not in sink_of:
                                sink_of[p] = n
                                todo.append(p)
        rows = {k: {"capacity": 0.0, "inflow": 0.0, "spill": (math.inf,), "down": None} for k in range(1, n + 1)}
        for y in range(h):
            for x in range(w):
                p = (x, y)
                while True:
                    falls = [((z[p[1], p[0]] - z[b, a]) / math.hypot(a - p[0], b - p[1]), -AROUND.index((a - p[0], b - p[1])), (a, b)) for a, b in around(z, *p)]
                    best = max(falls)
                    if best[0] <= 0:
                        break
                    p = best[2]
                if p in sink_of:
                    rows[sink_of[p]]["inflow"] += cell * rain
        for (x, y), k in sink_of.items():
            rows[k]["capacity"] += (level[y, x] - z[y, x]) * cell
            for i, (dx, dy) in enumerate(AROUND):
                a, b = x + dx, y + dy
                inside = 0 <= a < w and 0 <= b < h
                if inside and sink_of.get((a, b)) == k:
                    continue
                key = (max(z[y, x], z[b, a]) if inside else z[y, x], y, x, i)
                if key < rows[k]["spill"]:
                    rows[k]["spill"], rows[k]["down"] = key, sink_of.get((a, b))
        done = set()
        for k in sorted(rows, key=lambda k: (rows[k]["spill"][0], k)):
            r = rows[k]
            r["stored"] = min(r["inflow"], r["capacity"])
            over = r["inflow"] - r["stored"]
            done.add(k)
            if r["down"] is not None and r["down"] not in done:
                rows[r["down"]]["inflow"] += over
        first = {k: 0.0 for k in rows}
        for k, r in rows.items():
            g = got_sinks[f, k]
            assert abs(g.capacity - r["capacity"]) < 1e-9 and abs(g.spill - r["spill"][0]) < 1e-12 and g.downstream == r["down"] and abs(g.stored - r["stored"]) < 1e-9
            cells = [p for p in sink_of if sink_of[p] == k]
            low, high = 0.0, max(level[y, x] - z[y, x] for x, y in cells)
            for _ in range(80):
                first[k] = (low + high) / 2
                low, high = (first[k], high) if sum(max(level[y, x] - z[y, x] - first[k], 0) for x, y in cells) * cell > r["stored"] else (low, first[k])
            want_ponds |= {(f, x, y): max(level[y, x] - z[y, x] - first[k], 0) for x, y in cells}
        assert n > 3 and sum(1 for key in got_sinks if key[0] == f) == n
    assert got_ponds.keys() == want_ponds.keys() and all(abs(got_ponds[k] - want_ponds[k]) < 1e-9 for k in want_ponds)


def test_spread_headings_in_rounds(spark, fields):
    rows, known, want = [], [], {}
    for f, z in fields.items():
        have = {}
        for y in range(z.shape[0]):
            for x in range(z.shape[1]):
                rows.append((f, x, y))
                if (x * 5 + y * 3) % 7 < 2 and x < 12:
                    d = math.radians((x * 31 + y * 17) % 360)
                    have[x, y] = (math.sin(d), math.cos(d))
        known += [(f, x, y, *v) for (x, y), v in have.items()]
        while True:
            new = {}
            for y in range(z.shape[0]):
                for x in range(z.shape[1]):
                    near = [have[p] for p in around(z, x, y) if p in have]
                    s = np.sum(near, axis=0) if near else np.zeros(2)
                    if (x, y) not in have and len(near) >= 2 and np.hypot(*s) > 1e-9:
                        new[x, y] = tuple(s / np.hypot(*s))
            if not new:
                break
            have |= new
        want |= {(f, *p): v for p, v in have.items()}
    got = haul.spread_headings(spark.createDataFrame(rows, "field_id int, bx int, by_ int"), spark.createDataFrame(known, "field_id int, bx int, by_ int, vx double, vy double"))
    got = {(r.field_id, r.bx, r.by_): (r.vx, r.vy) for r in got.collect()}
    assert got.keys() >= want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_routes_meet_themselves_and_end(spark):
    """A line that ends, a ring with a tail, and a long line cut at the most steps."""
    nxt = [(0, i, 0, i + 1, 0) for i in range(37)] + [(1, i, 1, i + 1 if i < 9 else 4, 1) for i in range(10)] + [(2, i, 2, i + 1, 2) for i in range(300)]
    starts = [(0, 1, 0, 0), (0, 2, 37, 0), (1, 3, 0, 1), (1, 4, 6, 1), (2, 5, 0, 2)]
    got = haul.routes(spark.createDataFrame(starts, "field_id int, path_id int, bx int, by_ int"), spark.createDataFrame(nxt, "field_id int, bx int, by_ int, nx int, ny int"), 100)
    assert {r.path_id: [p.x for p in r.route] for r in got.collect()} == {1: list(range(38)), 2: [37], 3: list(range(10)), 4: [6, 7, 8, 9, 4, 5], 5: list(range(101))}


def test_smooth_paths_turn_within_limits(spark):
    """Ends stay, curves keep to their bins' boxes, and straight runs stay straight."""
    bins = [(x, 3) for x in range(8)] + [(7, y) for y in range(4, 10)]
    steps = [(0, 1, i, x + 0.5, y + 0.5, 90.0 if i < 7 else 0.0) for i, (x, y) in enumerate(bins)] + [(0, 2, i, 0.5, i + 0.5, 0.0) for i in range(6)]
    got = haul.smooth_paths(spark.createDataFrame(steps, "field_id int, path_id int, point_no int, x double, y double, heading_deg double")).toPandas().sort_values("point_no")
    bend, straight = (got[got.path_id == k][["x", "y"]].to_numpy() for k in (1, 2))
    assert np.allclose(bend[[0, -1]], [[0.5, 3.5], [7.5, 9.5]]) and np.allclose(straight, [[0.5, 0.5], [0.5, 5.5]])
    assert bend[:, 0].max() <= 7.72 + 1e-9 and bend[:, 1].min() >= 3.28 - 1e-9 and len(bend) > 10


def test_plane_with_import_and_without_root(spark):
    rng = np.random.default_rng(2)
    z = 30 + rng.random(400)
    cells = spark.createDataFrame([(0, i * 0.6, i % 20 * 0.6, float(v)) for i, v in enumerate(z)] + [(1, 0.0, 0.0, 150.0)], "field_id int, x double, y double, z double")
    area = 0.6096**2
    got = {r.field_id: r.c for r in surface.balanced_plane(cells, 0.0, 0.0, 1.2, 5.0, 2.0).collect()}
    cut, fill = np.maximum(z - got[0], 0).sum() * area, np.maximum(got[0] - z, 0).sum() * area
    assert abs(cut + 5.0 - 1.2 * fill - 2.0) < 1e-6 and got[1] is None


def test_reset_begins_anew(spark):
    """A steady receiver is Stable after 15 s, and again only 15 s after a reset."""
    fixes = [(1, k, k * 1000, 36.0, -93.5, 0.1, "Fix", k == 40) for k in range(70)]
    df = spark.createDataFrame(fixes, "machine_id long, event_id long, fast_ms long, lat double, lon double, speed_kph double, rtk string, reset boolean")
    state = {r.event_id: r.state for r in live.quality_states(df).collect()}
    assert [state[k] for k in (14, 15, 39, 40, 54, 55)] == ["Unstable", "Stable", "Stable", "Unstable", "Unstable", "Stable"] and state[69] == "Stable"
    plain = {r.event_id: r.state for r in live.quality_states(df.drop("reset")).collect()}
    assert plain[55] == "HighQuality"


def test_marks_on_bends(spark):
    """A mark that falls on a bend has the direction of the step behind it; 625 marks of 21.336 m end on one 5334 steps from the end."""
    zigzag = "SELECT 0 AS field_id, {p} AS path_id, CAST(id AS INT) AS point_no, id % 2 * 2.0D AS x, id * 1.5D AS y FROM range({n})"
    got = haul.markers(spark.sql(zigzag.format(p=0, n=6)), 5.0).orderBy("marker_no").collect()
    assert [(r.marker_no, r.y) for r in got] == [(0, 7.5), (1, 4.5), (2, 1.5)]
    east, west = math.degrees(math.atan2(2.0, 1.5)), 360 - math.degrees(math.atan2(2.0, 1.5))
    assert np.allclose([r.heading_deg for r in got], [east, west, west])
    far = haul.markers(spark.sql(zigzag.format(p=1, n=5337))).orderBy("marker_no").collect()
    assert [r.marker_no for r in far] == list(range(626)) and abs(far[625].y - 3.0) < 1e-9 and abs(far[625].heading_deg - east) < 1e-9


def test_points_of_bins_are_numbered_by_path(spark, sf):
    """Places are those in the path's order, and are known before bins meet their paths: nothing behind that join is moved or sorted."""
    cells = spark.createDataFrame([(0, x, y, 2.0 - x % 2, 1.0) for x in range(4) for y in range(3)], "field_id int, bx int, by_ int, current double, target double")
    points = spark.createDataFrame([(0, p, i * 7 % 10, 1.0 * i, 0.0) for p in range(4) for i in range(10)], "field_id int, path_id int, point_no int, x double, y double")
    got = haul.path_of_bin(cells, cells.selectExpr("field_id", "bx", "by_", "bx AS path_id"), points)
    assert "Window" not in catalog.QUERIES["T02_path_order"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    rows = got.collect()
    assert len(rows) == 60 and all(r.place == r.point_no + 1 and r.path_id == r.bx and r.bx % 2 == 0 for r in rows)
