"""Points to bins: georeferencing, extents, bins, dense grids, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AROUND, BIN_M, CY_PER_M3, M2_PER_ACRE
from ..functions import geo

KEY = ["field_id", "bx", "by_"]


def let(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that leave a generator: else Spark would put their formulas into every use of them."""
    return rows.select(*[F.col(k) for k in rows.columns if k not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def georeferenced(points: DataFrame) -> DataFrame:
    """points (lat, lon) with zone, e and n."""
    kept = points.withColumn("zone", geo.utm_zone(F.col("lon")))
    angles = geo.utm_angles(F.col("lat"), F.col("lon"), F.col("zone"))
    kept = let(kept, **{f"__{k}": v for k, v in angles.items()})
    e, n = geo.utm_series(F.col("lat"), {k: F.col(f"__{k}") for k in angles})
    return let(kept, e=e, n=n).drop(*[f"__{k}" for k in angles])


def shifted(points: DataFrame, east: Column, north: Column) -> DataFrame:
    """points with lat and lon moved so many metres east and north, through UTM; no offset leaves the place itself."""
    names = points.columns
    own = {k: f"__{k}_before" for k in ("zone", "e", "n") if k in names}
    got = let(points, __east=east.cast("double"), __north=north.cast("double")).withColumnsRenamed(own)
    got = georeferenced(got)
    got = let(got, __p=geo.footpoint(F.col("n") + F.col("__north"), F.col("lat") >= 0))
    lat, lon = geo.from_footpoint(F.col("__p"), F.col("e") + F.col("__east"), F.col("zone"))
    got = let(got, __lat=lat, __lon=lon)
    still = (F.col("__east") == 0) & (F.col("__north") == 0)
    moved = {"lat": F.when(still, F.col("lat")).otherwise(F.col("__lat")), "lon": F.when(still, F.col("lon")).otherwise(F.pmod(F.col("__lon") + 180.0, F.lit(360.0)) - 180.0)}
    return got.select(*[moved[k].alias(k) if k in moved else F.col(own.get(k, k)).alias(k) for k in names])


def field_extents(points: DataFrame, pad: bool = False) -> DataFrame:
    """One row a field: extents in metres, centroid, zone of the south-west corner, grid size. pad adds a bin on each side and one more, as for designs."""
    p = F.lit(BIN_M if pad else 0.0)
    got = points.groupBy("field_id").agg(
        (F.min("e") - p).alias("min_e"), (F.min("n") - p).alias("min_n"), (F.max("e") + p).alias("max_e"), (F.max("n") + p).alias("max_n"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.min_by("zone", F.struct("n", "e")).alias("zone"), F.count("*").alias("n_points"),
    )
    size = lambda lo, hi: (F.ceil((F.col(hi) - F.col(lo)) / BIN_M) + (1 if pad else 0)).cast("int")
    return got.withColumn("width", size("min_e", "max_e")).withColumn("height", size("min_n", "max_n"))


def binned(points: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """points with bx, by_, width and height of their field; one row a field is joined."""
    extents = field_extents(points) if extents is None else extents
    got = points.join(extents.select("field_id", "min_e", "min_n", "width", "height"), "field_id")
    return got.withColumn("bx", geo.bin_index(F.col("e"), F.col("min_e"))).withColumn("by_", geo.bin_index(F.col("n"), F.col("min_n")))


def in_grid() -> Column:
    return (F.col("bx") >= 0) & (F.col("by_") >= 0) & (F.col("bx") < F.col("width")) & (F.col("by_") < F.col("height"))


def bin_means(points: DataFrame, skip_level: bool = False) -> DataFrame:
    """Mean heights of each bin's points inside the grid, and its cut or fill by the sign of the mean difference. skip_level leaves out points at grade."""
    inside = points.where(in_grid())
    if skip_level:
        inside = inside.where(F.col("existing") != F.col("target"))
    got = inside.groupBy(*KEY).agg(F.avg("existing").alias("existing"), F.avg("target").alias("target"), F.count("*").alias("n_points"))
    d = F.col("existing") - F.col("target")
    return got.withColumn("cut_m", F.when(d > 0, d).otherwise(0.0)).withColumn("fill_m", F.when(d < 0, -d).otherwise(0.0))


def dense(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Every bin of the fields' grids (width, height), with the cells' columns where there are any."""
    every = fields.withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("by_", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return every.join(cells, KEY, "left")


def volumes(cells: DataFrame) -> DataFrame:
    """Planned cut and fill in cubic yards, bins and acres of each field."""
    d = F.col("existing") - F.col("target")
    cy = BIN_M * BIN_M * CY_PER_M3
    got = cells.where("existing IS NOT NULL AND target IS NOT NULL").groupBy("field_id")
    return got.agg(
        (F.sum(F.when(d > 0, d).otherwise(0.0)) * cy).alias("planned_cut_cy"), (F.sum(F.when(d < 0, -d).otherwise(0.0)) * cy).alias("planned_fill_cy"),
        F.count("*").alias("n_bins"), (F.count("*") * (BIN_M * BIN_M / M2_PER_ACRE)).alias("acres"),
    )


def volumes_by_band(cells: DataFrame) -> DataFrame:
    """Bins, cut and fill of each field and cut/fill band."""
    d = F.col("existing") - F.col("target")
    cy = BIN_M * BIN_M * CY_PER_M3
    got = cells.withColumn("band", geo.cut_fill_band(d)).groupBy("field_id", "band")
    return got.agg(F.count("*").alias("n_bins"), (F.sum(F.greatest(d, F.lit(0.0))) * cy).alias("cut_cy"), (F.sum(F.greatest(-d, F.lit(0.0))) * cy).alias("fill_cy"))


def neighbours(cells: DataFrame, diagonal: bool = True, *columns: str) -> DataFrame:
    """(field_id, bx, by_, k, columns): each cell sent to the cells around it; k is the place, in the order of AROUND, of the sender as the receiver sees it.

    Spark estimates a table's size by its compressed files and takes no account of an explode, so it would broadcast what is
    joined here however large the grid is: the next join is told to merge.
    """
    sides = [(k, dx, dy) for k, (dx, dy) in enumerate(AROUND) if diagonal or 0 in (dx, dy)]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, dx, dy in sides])).alias("s")
    sent = cells.select("field_id", "bx", "by_", *columns, steps)
    return sent.select("field_id", (F.col("bx") - F.col("s.dx")).alias("bx"), (F.col("by_") - F.col("s.dy")).alias("by_"), F.col("s.k").alias("k"), *columns).hint("merge")
