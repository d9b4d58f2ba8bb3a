"""Sources through files, and operators without SQL against formulas written out in Python."""

import math

import numpy as np

from loamgrid.constants import AROUND, SPHERE_M
from loamgrid.functions import geo
from loamgrid.operators import cover, drainage, gnss, grid, surface, tables
from loamgrid.plans.base import view
from loamgrid.sources import readers


def test_files_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "a.agd").write_text("head,,,,,,\r\n36.1,-93.2,30.5,30.25,0.000,3GRD,first\r\n36.2,-93.3,0,30,,3GRD,no height\r\n\r\n36.3,-93.4,31,30,-0.5,BM1,mark\r\n")
    (tmp_path / "b.agd").write_text("head,,,,,,\n36.5,-93.5,29,30,0.75,3GRD,short,more\nbad\n")
    got = {(r.file, r.comment): (r.seq, r.kind, r.cutfill_m) for r in readers.points_strict(readers.lines_of(spark, str(tmp_path / "*.agd"))).collect()}
    assert got == {("a.agd", "first"): (1, "point", 0.25), ("a.agd", "mark"): (4, "benchmark", 0.5), ("b.agd", "short"): (1, "point", -0.75)}
    lenient = readers.points_lenient(readers.lines_of(spark, str(tmp_path / "*.agd"))).collect()
    assert sorted((r.file, r.seq) for r in lenient) == [("a.agd", 1), ("a.agd", 2), ("a.agd", 4), ("b.agd", 1)]
    (tmp_path / "h.csv").write_text("lat,lon,direction,source\n36.1,-93.1,90,image\nx,y,z,w\n36.2,-93.2,45.5,\n")
    assert [(r.seq, r.direction_deg) for r in readers.haul_samples(readers.lines_of(spark, str(tmp_path / "h.csv"))).collect()] == [(1, 90.0), (3, 45.5)]


def test_survey_files_both_ways(spark, tmp_path):
    (tmp_path / "s.ags").write_text("Latitude,Longitude,Elevation,Code\n36.00000001,-93.5,101.25,2PER\n36.1,-93.4,100.5,MB\nnone,1,2,3GRD\n36.2,-93.3,99.125,3GRD\n36.3,-93.2,98,BM2\n")
    rows, bad = readers.survey(readers.lines_of(spark, str(tmp_path / "s.ags")))
    assert [(r.seq, r.line) for r in bad.collect()] == [(3, "none,1,2,3GRD")]
    readers.survey_lines(rows).select("line").coalesce(1).write.text(str(tmp_path / "out"))
    again = readers.survey(readers.lines_of(spark, str(tmp_path / "out" / "part-*")))[0].orderBy("seq").collect()
    assert [(r.lat, r.lon, r.elevation_m, r.kind) for r in again] == [(36.1, -93.4, 100.5, "master"), (36.3, -93.2, 98.0, "benchmark"), (36.00000001, -93.5, 101.25, "boundary"), (36.2, -93.3, 99.125, "interior")]


def test_multiplane_files_both_ways(spark, tmp_path):
    """Feet and metres, offsets of the master itself, and lines in feet from it again."""
    body = "2\t100.5\t-40\t101\tB\n3\t0\t250.25\t99\tBM1\n4\t-10\t10\t98.5\t\n"
    for name in ("plain.txt", "plain_m.txt"):
        (tmp_path / name).write_text("1\t0\t0\t100\tMB 36 5 24.5 N / 93 30 0.0 W\n" + body)
    rows = readers.multiplane(readers.lines_of(spark, str(tmp_path / "plain*.txt"))).cache()
    lat0, lon0 = 36 + 5 / 60 + 24.5 / 3600, -93.5
    placed = grid.georeferenced(rows).cache()
    e0, n0 = spark.range(1).select(*[x.alias(k) for x, k in zip(geo.to_utm(geo.F.lit(lat0), geo.F.lit(lon0)), ("e", "n"), strict=True)]).first()
    for r in placed.collect():
        unit = 1.0 if r.file == "plain_m.txt" else 0.3048
        de, dn = {1: (100.5, -40), 2: (0, 250.25), 3: (-10, 10)}[r.seq]
        assert abs(r.e - e0 - de * unit) < 2e-3 and abs(r.n - n0 - dn * unit) < 2e-3
    masters = spark.createDataFrame([(f, e0, n0) for f in ("plain.txt", "plain_m.txt")], "file string, e0 double, n0 double")
    lines = [r.line.split("\t") for r in readers.multiplane_lines(placed, masters).where("file = 'plain.txt'").orderBy("line_no").collect()]
    assert [x[0] for x in lines] == ["2", "3", "4"] and [x[4] for x in lines] == ["BM1", "B", ""]
    assert np.allclose([float(x[1]) for x in lines], [0, 100.5, -10], atol=0.01) and np.allclose([float(x[2]) for x in lines], [250.25, -40, 10], atol=0.01)


def test_shift_keeps_other_columns_and_still_places(spark):
    rows = spark.createDataFrame([(1, 36.0, -93.5, "a", 1.5), (2, -36.0, 179.9999, "b", 2.5)], "k int, lat double, lon double, zone string, e double")
    still = grid.shifted(rows, geo.F.lit(0.0), geo.F.lit(0.0))
    assert still.columns == rows.columns and sorted(map(tuple, still.collect())) == sorted(map(tuple, rows.collect()))
    moved = {r.k: r for r in grid.shifted(rows, geo.F.lit(100.0), geo.F.lit(-50.0)).collect()}
    assert moved[2].lon < -179 and moved[1].zone == "a" and moved[1].lat < 36 < moved[1].lat + 0.001


def test_squares_and_restored_heights(spark):
    r = cover.square_extent(spark.createDataFrame([(36.0, -93.5)], "lat double, lon double"), 40.0).first()
    side = math.sqrt(40 * 4046.8564224)
    assert abs(math.radians(r.north - r.south) * SPHERE_M - side) < 1e-6 and abs(math.radians(r.east - r.west) * SPHERE_M * math.cos(math.radians(36.0)) - side) < 1e-3
    cells = spark.createDataFrame([(0, 30.0, 29.5), (1, None, None), (2, 31.0, None)], "bx int, existing double, target double")
    assert {r.bx: r.target for r in tables.stripped(cells, 0.25).collect()} == {0: 29.75, 1: -0.25, 2: 30.75}
    assert {r.bx: r.existing for r in tables.restored(cells, -0.25, coverage_only=True).collect()} == {0: 29.75}


def move(lat, lon, heading, metres):
    d, p, h = metres / SPHERE_M, math.radians(lat), math.radians(heading)
    q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(h))
    return math.degrees(q), lon + math.degrees(math.atan2(math.sin(h) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q)))


def test_blades_courses_and_tilt(spark, sf):
    f = view(spark, sf, "v_fixes").withColumn("mode", geo.F.expr("if(event_id % 4 = 0, 'FILL', 'CUT')"))
    before = {}
    for r in gnss.blade_edges(gnss.runs(f, "mode"), 3.0).orderBy("machine_id", "fast_ms").collect():
        left, right = move(r.lat, r.lon, r.heading_deg - 90, 1.5), move(r.lat, r.lon, r.heading_deg + 90, 1.5)
        assert np.allclose([r.left_lat, r.left_lon, r.right_lat, r.right_lon], [*left, *right], atol=1e-9, rtol=0)
        old = before.get((r.machine_id, r.run_id))
        assert (r.previous_left_lat is None) if old is None else np.allclose([r.previous_left_lat, r.previous_left_lon, r.previous_right_lat, r.previous_right_lon], old, atol=1e-9, rtol=0)
        before[r.machine_id, r.run_id] = (*left, *right)
    last = {}
    for r in gnss.course(f).orderBy("machine_id", "fast_ms").collect():
        if (old := last.get(r.machine_id)) is not None:
            a, b, dl = math.radians(old[0]), math.radians(r.lat), math.radians(r.lon - old[1])
            metres = 2 * SPHERE_M * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dl / 2) ** 2))
            want = math.degrees(math.atan2(math.sin(dl) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(dl))) % 360
            assert abs(r.moved_m - metres) < 1e-6 and (abs((r.course_deg - want + 180) % 360 - 180) < 1e-6 and abs((r.heading_deg + r.gyro_offset_deg - want + 180) % 360 - 180) < 1e-6 if metres > 1 else r.course_deg is None)
        last[r.machine_id] = (r.lat, r.lon)
    tilted = spark.createDataFrame([(36.0, -93.5, 30.0, 100.0, 5.0, -3.0, 3.2, 0.1, -0.4)], "lat double, lon double, heading_deg double, altitude_m double, roll_deg double, pitch_deg double, antenna_height_m double, antenna_right_m double, antenna_forward_m double")
    r = gnss.tilt_corrected(tilted).first()
    roll, pitch = math.radians(5), math.radians(-3)
    place = move(36.0, -93.5, 30.0, -(3.2 * math.sin(pitch) - 0.4 * math.cos(pitch)))
    place = move(*place, 120.0, -(3.2 * math.sin(roll) + 0.1 * math.cos(roll)))
    assert np.allclose([r.ground_lat, r.ground_lon], place, atol=1e-10, rtol=0) and abs(r.ground_m - (100 - 3.2 * math.cos(roll) * math.cos(pitch))) < 1e-9


def test_covered_bins_by_sampling(spark):
    """Clipped areas against a fine raster of the ring, and the least coverage."""
    ring = [(0.3, 0.2), (2.4, 0.9), (1.8, 2.7), (0.5, 2.0)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "seq int, ring array<struct<x:double,y:double>>")
    got = {(r.bx, r.by_): r.area_m2 for r in cover.polygon_bins(df, 0.6096, 0.0, "seq").collect()}
    step = 0.6096 / 60
    c = (np.arange(360) + 0.5) * step
    x, y = np.meshgrid(c, c)
    inside = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        inside ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    area = inside.reshape(6, 60, 6, 60).sum(axis=(1, 3)) * step * step
    assert all(abs(area[b, a] - got.get((a, b), 0.0)) < 0.006 for a in range(6) for b in range(6))
    some = {(r.bx, r.by_) for r in cover.polygon_bins(df, 0.6096, 0.3, "seq").collect()}
    assert some == {k for k, v in got.items() if v >= 0.3 * 0.6096**2} and len(some) < len(got)


def test_masks_of_two_surveys(spark):
    """Envelope, closing, holes and largest component, cell by cell in numpy."""
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for f in (0, 3):
        seen = np.zeros((24, 30), bool)
        for _ in range(26):
            seen[rng.integers(4, 18), rng.integers(4, 15 + 4 * (f > 0))] = True
        seen[20, 25] = True
        at = list(zip(*np.nonzero(seen), strict=True))
        rows += [(f, int(x), int(y)) for y, x in at]
        near = lambda m: np.array([np.roll(np.roll(np.pad(m, 4), dy, 0), dx, 1) for dx, dy in (*AROUND, (0, 0))])
        cut = lambda m: m[4:-4, 4:-4]
        full = np.zeros_like(seen)
        for y in range(24):
            if (k := np.flatnonzero(seen[y])).size:
                full[y, k[0] : k[-1] + 1] = True
        for x in range(30):
            if (k := np.flatnonzero(seen[:, x])).size:
                full[k[0] : k[-1] + 1, x] = True
        wide = np.pad(full, 8)
        for _ in range(2):
            wide = cut(near(wide).any(axis=0))
        for _ in range(2):
            wide = cut(near(wide).all(axis=0))
        free, grown = np.zeros_like(wide), [(0, 0)]
        while grown:
            y, x = grown.pop()
            if 0 <= y < wide.shape[0] and 0 <= x < wide.shape[1] and not wide[y, x] and not free[y, x]:
                free[y, x] = True
                grown += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        solid, parts = ~free, []
        while solid.any():
            part, grown = set(), [tuple(np.argwhere(solid)[0])]
            while grown:
                y, x = grown.pop()
                if 0 <= y < solid.shape[0] and 0 <= x < solid.shape[1] and solid[y, x]:
                    solid[y, x] = False
                    part.add((x - 8, y - 8))
                    grown += [(y + dy, x + dx) for dx, dy in AROUND]
            parts.append(part)
        want |= {(f, int(x), int(y)) for x, y in max(parts, key=len)} | {(f, int(x), int(y)) for y, x in at}
    got = {tuple(r) for r in surface.observed_mask(spark.createDataFrame(rows, "field_id int, bx int, by_ int")).select("field_id", "bx", "by_").collect()}
    assert got == want


def test_flow_over_two_fields(spark):
    """D-infinity flow summed cell by cell from the highest down."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for f, (h, w) in {0: (9, 11), 5: (13, 6)}.items():
        z = np.round(rng.random((h, w)) + np.arange(w) * 0.05, 3)
        rows += [(f, x, y, float(z[y, x])) for y in range(h) for x in range(w)]
        dem = spark.createDataFrame([r for r in rows if r[0] == f], "field_id int, bx int, by_ int, z double")
        edges = {}
        for e in drainage.d_infinity(dem).collect():
            edges.setdefault((e.bx, e.by_), []).append((e.rx, e.ry, e.share))
        flow = {(x, y): 1.0 for y in range(h) for x in range(w)}
        for x, y in sorted(flow, key=lambda p: -z[p[1], p[0]]):
            out = edges.get((x, y), [])
            assert not out or abs(sum(s for _, _, s in out) - 1) < 1e-9
            for a, b, s in out:
                assert max(abs(a - x), abs(b - y)) == 1
                flow[a, b] += flow[x, y] * s
        want |= {(f, *p): v for p, v in flow.items()}
    got = {(r.field_id, r.bx, r.by_): r.flow for r in drainage.flow_cells(spark.createDataFrame(rows, "field_id int, bx int, by_ int, z double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cascade_in_turns(spark):
    """Water passed on sink by sink in order of spill, and ponds' levels by filling."""
    rows = [(f, k, float(cap), float(run), float(spill), down) for f, sinks in {0: [(1, 5, 9, 3.0, 2), (2, 4, 1, 4.0, 3), (3, 9, 2, 5.0, None), (4, 1, 6, 6.0, 1)], 7: [(1, 2, 8, 1.0, 2), (2, 2, 0, 1.0, 1)]}.items() for k, cap, run, spill, down in sinks]
    want = {}
    for f in (0, 7):
        own = {r[1]: list(r) for r in rows if r[0] == f}
        got, done = {k: r[3] for k, r in own.items()}, set()
        for k in sorted(own, key=lambda k: (own[k][4], k)):
            over = max(0.0, got[k] - own[k][2])
            done.add(k)
            down = own[k][5]
            passes = down in own and down not in done
            if passes:
                got[down] += over
            want[f, k] = (min(got[k], own[k][2]), 0.0 if passes else over)
    table = spark.createDataFrame([(f, k, 1, cap, run, spill, down) for f, k, cap, run, spill, down in rows], "field_id int, sink int, n_cells long, capacity double, inflow double, spill double, downstream int")
    out = {(r.field_id, r.sink): (r.stored, r.lost) for r in drainage.cascaded(table).collect()}
    assert out == want
    depths = [0.9, 0.7, 0.7, 0.2, 0.05]
    regions = spark.createDataFrame([(0, i, 0, 1, 30 - d, d) for i, d in enumerate(depths)], "field_id int, bx int, by_ int, sink int, z double, depth double")
    for volume in (0.0, 0.1, 0.5, 1.4, 2.55):
        level, low = 1.0, 0.0
        for _ in range(100):  # the share of depth that stays dry, by halving
            mid = (low + level) / 2
            low, level = (mid, level) if sum(max(d - mid, 0) for d in depths) * 4.0 > volume * 4.0 else (low, mid)
        ponds = {r.bx: r.pond for r in drainage.pond_depths(regions, spark.createDataFrame([(0, 1, volume * 4.0)], "field_id int, sink int, stored double"), 4.0).collect()}
        assert all(abs(ponds[i] - max(d - level, 0)) < 1e-9 for i, d in enumerate(depths))


def test_exact_percentiles_of_large_and_small_groups(spark):
    """A sketch of low accuracy, so that brackets are real; ties, heavy tails, one value, nulls, no value."""
    from loamgrid.operators.quantiles import exact_percentiles

    rng = np.random.default_rng(5)
    groups = {0: rng.normal(0, 1, 5000), 1: np.round(rng.normal(0, 2, 4000)), 2: np.exp(rng.normal(0, 40, 3000)), 3: np.array([7.5]), 4: rng.random(2), 5: np.full(900, 3.0), 6: np.r_[np.zeros(2000), 1.0]}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [(0, None), (8, None)]
    table = spark.createDataFrame(rows, "k int, z double").repartition(7)
    shares = {"low": 0.25, "mid": 0.5, "high": 0.75, "top": 0.999, "first": 0.0, "last": 1.0}
    for accuracy in (50, 10_000):
        got = {r.k: r for r in exact_percentiles(table, ["k"], "z", shares, accuracy=accuracy).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert np.allclose([got[k][n] for n in shares], np.quantile(values, list(shares.values())), rtol=1e-12)
