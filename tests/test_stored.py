"""Upserts by key and appended events, repeated and in parts."""

import os

import numpy as np

from loamgrid.operators import tables
from loamgrid.streaming import live


def test_bins_one_by_one_and_in_bulk(spark, tmp_path):
    """Against a dictionary; folders without a changed bin keep their files; the same rows again change nothing."""
    path, rng = f"file://{tmp_path}/bins", np.random.default_rng(7)
    schema = "field_id int, bx int, by_ int, initial_m double, current_m double, n_cuts long"
    first = [(f, x, y, 30.0 + x, 30.0 + x, 0) for f in (0, 1) for x in range(0, 300, 7) for y in range(0, 140, 35)]
    tables.upsert_bins(spark.createDataFrame(first, schema), path, 0.5)
    have = {r[:3]: list(r[3:]) for r in first}
    files = lambda: {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(tmp_path / "bins") for n in names if n.endswith(".parquet")}
    before = files()
    tables.upsert_bins(spark.createDataFrame([(0, 7, 35, None, 29.25, 4)], schema), path, 0.5)
    have[0, 7, 35][1:] = [29.25, 4]
    same = before.items() & files().items()
    assert all("field_id=0/tile=0_0" in f for f, t in before.items() if (f, t) not in same) and len(same) > 3
    one = tables.bins_at(spark, path, 0, 7, 35, 0.5).collect()
    assert [(r.initial_m, r.current_m, r.n_cuts) for r in one] == [(37.0, 29.25, 4)] and tables.bins_at(spark, path, 0, 7, 36, 0.5).count() == 0
    for _ in range(2):
        bulk = [(int(f), int(x), int(y), None if k % 2 else 40.0, 20.0 + k, k) for k, (f, x, y) in enumerate(rng.integers((0, 0, 0), (3, 310, 140), (200, 3)))]
        bulk = list({r[:3]: r for r in bulk}.values())
        for _ in range(2):
            tables.upsert_bins(spark.createDataFrame(bulk, schema).select("field_id", "bx", "by_", "initial_m", "current_m", "n_cuts"), path, 0.5)
        for r in bulk:
            old = have.get(r[:3], [None] * 3)
            have[r[:3]] = [b if a is None else a for a, b in zip(r[3:], old, strict=True)]
    got = {(r.field_id, r.bx, r.by_): [r.initial_m, r.current_m, r.n_cuts] for r in tables.read_field_state(spark, path, 0.5).collect()}
    assert got == have


def test_metadata_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    rows = lambda *r: spark.createDataFrame(list(r), "field_id int, name string, value double")
    tables.upsert(rows((1, "CompletedCutCY", 5.0), (1, "Zone", 15.0), (2, "Zone", 16.0)), path, ["field_id", "name"], ["field_id"])
    tables.upsert(rows((1, "CompletedCutCY", 7.5), (3, "Zone", 14.0)), path, ["field_id", "name"], ["field_id"])
    got = {r.field_id: (r.CompletedCutCY, r.Zone) for r in tables.metadata(spark.read.parquet(path), ["CompletedCutCY", "Zone"]).collect()}
    assert got == {1: (7.5, 15.0), 2: (None, 16.0), 3: (None, 14.0)}


def test_appended_events_come_back(spark, tmp_path):
    schema = "field_id int, event_id long, type string, value double"
    files = [[(0, 1, "TractorLatitude", 36.5), (1, 2, "FrontBladeHeight", 0.25)], [(0, 3, "Speedkph", 4.0), (9, 4, "TractorLongitude", -93.0)], [(0, 5, "TractorLongitude", -93.5)]]
    calibration = spark.createDataFrame([(0, 0.5, 0.25, 0.125), (1, 1.0, 1.0, 0.0625)], "field_id int, dlat double, dlon double, dheight double")
    where = str(tmp_path / "in")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(spark.read.parquet(where).schema).parquet(where)
        for _ in range(1 + k % 2):
            live.append_events(stream, calibration, f"file://{tmp_path}/log")
    stored = {r.event_id: r.value for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log/out").collect()}
    assert stored == {1: 36.0, 2: 0.1875, 3: 4.0, 4: -93.0, 5: -93.75}
    back = live.event_table(spark, f"file://{tmp_path}/log", stream.schema, calibration).collect()
    assert sorted((r.event_id, r.value) for r in back) == sorted((r[1], r[3]) for rows in files for r in rows)
