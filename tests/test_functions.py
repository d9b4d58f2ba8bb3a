"""Column functions in SQL text, longitudes beyond 180, and folders of field databases."""

import math

from pyspark.sql import functions as F

from loamgrid.functions import geo, registered
from loamgrid.operators import tables
from loamgrid.sources import readers


def test_sql_functions_equal_columns(spark):
    registered.register(spark)
    rows = spark.createDataFrame([(36.5, -93.25, 36.4, -93.2, 33.0), (-12.0, 170.1, -12.2, 179.9, 271.5), (None, 1.0, 2.0, 3.0, 4.0)], "lat double, lon double, lat0 double, lon0 double, d double").cache()
    for text, column in (
        ("to_utm(lat, lon)", F.struct(*[x.alias(n) for x, n in zip(geo.to_utm(F.col("lat"), F.col("lon")), "en", strict=True)])),
        ("haversine_m(lat, lon, lat0, lon0)", geo.haversine(*map(F.col, ("lat", "lon", "lat0", "lon0")))),
        ("bearing_deg(lat, lon, lat0, lon0)", geo.bearing(*map(F.col, ("lat", "lon", "lat0", "lon0")))),
        ("moved(lat, lon, d, 12.5D).lon", geo.move(F.col("lat"), F.col("lon"), F.col("d"), F.lit(12.5))[1]),
        ("bin_index(d, 1.5D)", geo.bin_index(F.col("d"), F.lit(1.5))),
        ("signed_turn_deg(d, 10.0D)", geo.signed_turn(F.col("d"), F.lit(10.0))),
        ("runoff_mm(50.0D, 85.0D)", geo.runoff_mm(F.lit(50.0), F.lit(85.0))),
    ):
        assert rows.select(F.expr(text).alias("r")).collect() == rows.select(column.alias("r")).collect(), text
    assert spark.sql("SELECT from_utm(to_utm(36.0D, -93.5D).e, to_utm(36.0D, -93.5D).n, utm_zone(-93.5D), true) AS p").first().p.lat - 36.0 < 1e-8
    assert set(registered.FUNCTIONS) <= {r.function.split(".")[-1] for r in spark.sql("SHOW USER FUNCTIONS").collect()}


def test_longitudes_are_wrapped(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate((180.0, -180.0, 181.0, -179.0, 179.0, 539.0, -93.5))], "k int, lon double")
    e, n = geo.to_utm(F.lit(36.0), F.col("lon"))
    got = rows.select("k", geo.utm_zone(F.col("lon")).alias("zone"), e.alias("e"), n.alias("n")).orderBy("k").collect()
    assert [r.zone for r in got] == [1, 1, 1, 1, 60, 60, 15]
    assert all(math.isclose(got[a].e, got[b].e, abs_tol=1e-6) and math.isclose(got[a].n, got[b].n, abs_tol=1e-6) for a, b in ((0, 1), (2, 3), (4, 5)))


def test_catalogue_of_a_tree(spark, tmp_path):
    for name in ("north/north.db", "north/north-V1.db", "north/north-V12.db", "south/a b/south-V2.db", "south/a b/image.png", "both/one.db", "both/two-V3.DB", "notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * 7)
    files = readers.folder_files(spark, f"file://{tmp_path}")
    assert {r.length for r in files.collect()} == {7}
    found = tables.databases(files)
    assert {(r.folder, r.field, r.version) for r in found.collect()} == {("north", "north", 0), ("north", "north", 1), ("north", "north", 12), ("south/a b", "south", 2), ("both", "one", 0), ("both", "two", 3)}
    assert {(r.folder, r.name) for r in tables.catalogue(found, "field").collect()} == {("north", "north"), ("south/a b", "south")}
    assert {r.field: r.next for r in found.groupBy("field").agg((F.max("version") + 1).alias("next")).collect()} == {"north": 13, "south": 3, "one": 1, "two": 4}
