"""The column functions as SQL functions, so that queries in SQL text can call them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geo

#: Name -> (arguments with types, result's fields or none, function of columns).
FUNCTIONS: dict[str, tuple[str, tuple[str, ...], Callable[..., object]]] = {
    "utm_zone": ("lon DOUBLE", (), geo.utm_zone),
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", (), geo.haversine),
    "bearing_deg": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", (), geo.bearing),
    "moved": ("lat DOUBLE, lon DOUBLE, heading DOUBLE, metres DOUBLE", ("lat", "lon"), geo.move),
    "local_mm": ("lat DOUBLE, lon DOUBLE, lat0 DOUBLE, lon0 DOUBLE", ("east", "north"), geo.local_mm),
    "flat_xy": ("lat DOUBLE, lon DOUBLE, lat0 DOUBLE, lon0 DOUBLE", ("x", "y"), geo.flat_xy),
    "flat_latlon": ("x DOUBLE, y DOUBLE, lat0 DOUBLE, lon0 DOUBLE", ("lat", "lon"), geo.flat_latlon),
    "bin_index": ("v DOUBLE, low DOUBLE", (), geo.bin_index),
    "bin_corner": ("bin INT, low DOUBLE", (), geo.bin_corner),
    "bin_centre": ("bin INT, low DOUBLE", (), geo.bin_centre),
    "normal_deg": ("deg DOUBLE", (), geo.normal),
    "signed_turn_deg": ("a DOUBLE, b DOUBLE", (), geo.signed_turn),
    "dms_to_degrees": ("dms STRING", (), geo.dms_to_degrees),
    "cut_fill_band": ("difference DOUBLE", (), geo.cut_fill_band),
    "runoff_mm": ("rain_mm DOUBLE, curve_number DOUBLE", (), geo.runoff_mm),
}


def register(spark: SparkSession) -> None:
    """Create the functions of FUNCTIONS in the session, and from_utm, to_utm and to_utm_zone. Each is an expression that Spark puts in place; several results come as a struct."""
    for name, (arguments, fields, function) in FUNCTIONS.items():
        pairs = [a.split(" ") for a in arguments.split(", ")]
        row = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in pairs])
        result = function(*[F.col(n) for n, _ in pairs])
        if fields:
            result = F.struct(*[x.alias(f) for x, f in zip(result, fields, strict=True)])
        one = row.select(result.alias("r"))
        _create(spark, name, arguments, one.schema["r"].dataType.simpleString(), _text(one))
    row = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (("e", "double"), ("n", "double"), ("zone", "int"), ("is_north", "boolean"), ("footpoint", "double"))])
    foot = _text(row.select(geo.footpoint(F.col("n"), F.col("is_north")).alias("r")))
    place = ", ".join(f"'{k}', {_text(row.select(x.alias('r')))}" for k, x in zip(("lat", "lon"), geo.from_footpoint(F.col("footpoint"), F.col("e"), F.col("zone")), strict=True))
    _create(spark, "from_utm", "e DOUBLE, n DOUBLE, zone INT, is_north BOOLEAN", "struct<lat:double,lon:double>", f"transform(array({foot}), footpoint -> named_struct({place}))[0]")
    # What both coordinates use is computed once, as an array's element: in place for each use it outgrows the code generator.
    row = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (("lat", "double"), ("lon", "double"), ("zone", "int"))])
    angles = geo.utm_angles(F.col("lat"), F.col("lon"), F.col("zone"))
    once = ", ".join(f"'{k}', {_text(row.select(x.alias('r')))}" for k, x in angles.items())
    names = {k: f"angle_{k}" for k in angles}
    row = spark.range(0).select(F.lit(None).cast("double").alias("lat"), *[F.lit(None).cast("double").alias(n) for n in names.values()])
    series = _text(row.select(F.struct(*[x.alias(f) for x, f in zip(geo.utm_series(F.col("lat"), {k: F.col(n) for k, n in names.items()}), "en", strict=True)]).alias("r")))
    body = f"transform(array(named_struct({once})), angle -> {re.sub('angle_', 'angle.', series)})[0]"
    _create(spark, "to_utm_zone", "lat DOUBLE, lon DOUBLE, zone INT", "struct<e:double,n:double>", body)
    _create(spark, "to_utm", "lat DOUBLE, lon DOUBLE", "struct<e:double,n:double>", "to_utm_zone(lat, lon, utm_zone(lon))")


def _create(spark: SparkSession, name: str, arguments: str, result: str, text: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {text}")


def _text(one: DataFrame) -> str:
    """The SQL of the only column of a DataFrame."""
    return one._jdf.queryExecution().analyzed().expressions().head().child().sql()

