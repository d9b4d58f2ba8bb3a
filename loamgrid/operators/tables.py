"""Stored forms and exports: field state, layers, height sentinels, tiles, elevation models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BIN_M, NO_DATA, NO_HEIGHT
from ..functions import geo
from . import cover, grid
from .loops import exists, remove, shared_dir

c = F.col
KEY = grid.KEY


def heights_from_stored(df: DataFrame, stored: str, name: str) -> DataFrame:
    return df.withColumn(name, F.nullif(c(stored), F.lit(NO_HEIGHT)))


def heights_to_stored(df: DataFrame, height: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(c(height), F.lit(NO_HEIGHT)))


def valid_heights(df: DataFrame, column: str) -> DataFrame:
    """Rows with a height that is there, finite, not zero and no sentinel."""
    z = c(column)
    return df.where(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")) & (z != 0) & (z != NO_HEIGHT) & (z != NO_DATA))


def zone_check(points: DataFrame) -> DataFrame:
    """points (lat, lon, zone) with in_zone: whether a point is in the zone of its field's south-west corner (the most frequent zone breaks no tie: the lowest longitude decides)."""
    corner = points.groupBy("field_id").agg(F.min_by("zone", F.struct("lon", "lat")).alias("corner_zone"))
    return points.join(corner, "field_id").withColumn("in_zone", c("zone") == c("corner_zone")).drop("corner_zone")


def crop_centre_bottom(cells: DataFrame, extents: DataFrame) -> DataFrame:
    """The centre half of the columns and the bottom quarter of the rows, with columns numbered anew."""
    got = cells.join(extents.select("field_id", "width", "height"), "field_id")
    left = F.floor(c("width") / 4.0).cast("int")
    got = got.where((c("bx") >= left) & (c("bx") < left + F.floor(c("width") / 2.0)) & (c("by_") < F.floor(c("height") / 4.0)))
    return got.withColumn("bx", c("bx") - left).drop("width", "height")


def combined_layers(existing: DataFrame, target: DataFrame, heading: DataFrame) -> DataFrame:
    return existing.join(target, KEY, "full").join(heading, KEY, "full")


def export_lines(cells: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """One CSV line a row, doubles with fixed digits, blanks for missing; in the order of field, bx, by_ without one sort of everything."""
    kinds = dict(cells.dtypes)
    text = [F.coalesce(F.format_string(f"%.{digits}f", c(x)) if kinds[x] == "double" else c(x).cast("string"), F.lit("")) if x not in ("bx", "by_") else c(x).cast("string") for x in columns]
    text = [F.when(c(x).isNull(), "").otherwise(t) for x, t in zip(columns, text, strict=True)]
    lines = cells.select(*KEY, F.concat_ws(",", *text).alias("line"))
    return lines.repartitionByRange(*KEY).sortWithinPartitions(*KEY)


def elevation_ranges(cells: DataFrame, column: str, widen_flat: float = 0.0) -> DataFrame:
    got = valid_heights(cells, column).groupBy("field_id").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    flat = c("low") == c("high")
    return got.select("field_id", F.when(flat, c("low") - widen_flat).otherwise(c("low")).alias("low"), F.when(flat, c("high") + widen_flat).otherwise(c("high")).alias("high"))


def tile_rollup(cells: DataFrame, tile_bins: int = cover.TILE_BINS) -> DataFrame:
    """Bins of each tile by class; coarser levels follow by halving tile keys."""
    got = cover.bins_to_tiles(cells, tile_bins).groupBy("field_id", "tile_x", "tile_y")
    return got.agg(F.count("*").alias("n_bins"), F.count_if(c("band") > 4).alias("n_cut"), F.count_if(c("band") < 4).alias("n_fill"), F.count_if(c("band") == 4).alias("n_grade"), F.avg("existing").alias("mean_existing"))


def statistics(cells: DataFrame, main_pct: float, cross_pct: float, heading_deg: float) -> DataFrame:
    a, b = geo.plane_slopes(main_pct, cross_pct, heading_deg)
    slope, heading = geo.composite_slope(F.lit(a), F.lit(b))
    return grid.volumes(cells).withColumn("heading", heading).withColumn("slope_pct", slope)


def write_field_state(cells: DataFrame, path: str, up: Column | float = 0.0) -> None:
    """Field state as Parquet, a folder a field, heights less the calibration ``up``, sentinels for missing ones; only the fields in cells are overwritten."""
    heights = [x for x, t in cells.dtypes if t == "double"]
    stored = cells.select(*[F.coalesce(c(x) - up, F.lit(NO_HEIGHT)).alias(x) if x in heights else c(x) for x in cells.columns])
    stored.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("field_id").parquet(path)


def read_field_state(spark, path: str, up: Column | float = 0.0) -> DataFrame:
    got = spark.read.parquet(path)
    heights = [x for x, t in got.dtypes if t == "double"]
    return got.select(*[(F.nullif(c(x), F.lit(NO_HEIGHT)) + up).alias(x) if x in heights else c(x) for x in got.columns])


def field_state_round_trip(cells: DataFrame, up: float = 0.25) -> DataFrame:
    path = f"{shared_dir(cells.sparkSession)}/field-state-{uuid.uuid4().hex}"
    write_field_state(cells, path, up)
    got = read_field_state(cells.sparkSession, path, up)
    return got.select(*KEY, *[F.round(x, 9).alias(x) for x in ("initial_m", "current_m")])


def upsert(rows: DataFrame, path: str, keys: list[str], parts: list[str]) -> None:
    """Insert rows into the Parquet table at path, or update those whose keys are there: a column that rows lack, or that is null in them, keeps its stored value.

    parts are key columns, or columns that follow from keys, by which the table has folders: only folders with a key in
    rows are read and rewritten (Spark's dynamic overwrite), whatever the table's size. What is written is staged first,
    and the same rows again change nothing, so a failed call is repeated. Of rows with equal keys one counts, the largest.
    """
    spark = rows.sparkSession
    rest = [x for x in rows.columns if x not in (*keys, *parts)]
    rows = rows.groupBy(*keys, *[p for p in parts if p not in keys]).agg(F.max(F.struct(*rest)).alias("__new")).select(*keys, *[p for p in parts if p not in keys], "__new.*") if rest else rows.distinct()
    if exists(spark, path):
        stored = spark.read.parquet(path)
        touched = stored.join(rows.select(*parts).distinct(), parts, "left_semi")
        new = rows.withColumnsRenamed({x: f"__new_{x}" for x in rest})
        both = touched.join(new, list(dict.fromkeys([*keys, *parts])), "full")
        kept = [F.coalesce(c(f"__new_{x}"), c(x)).alias(x) if x in rest else c(x) for x in stored.columns]
        rows = both.select(*kept, *[c(f"__new_{x}").alias(x) for x in rest if x not in stored.columns])
    held = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows.write.parquet(held)
    back = spark.read.schema(rows.schema).parquet(held)
    back.repartition(*parts).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).parquet(path)
    remove(spark, held)


def with_tile(cells: DataFrame, tile_bins: int = cover.TILE_BINS) -> DataFrame:
    """cells with tile, the part of its field in which a bin is stored."""
    at = lambda x: F.floor(c(x) / float(tile_bins)).cast("int").cast("string")
    return cells.withColumn("tile", F.concat_ws("_", at("bx"), at("by_")))


def upsert_bins(cells: DataFrame, path: str, up: Column | float = 0.0) -> None:
    """Insert or update bins of the field state at path, one or many: heights less the calibration ``up``; a height that cells lack stays as it is. Only the tiles of these bins are rewritten."""
    heights = [x for x, t in cells.dtypes if t == "double"]
    stored = with_tile(cells).select(*[(c(x) - up).alias(x) if x in heights else c(x) for x in (*cells.columns, "tile")])
    upsert(stored, path, KEY, ["field_id", "tile"])


def bins_at(spark: SparkSession, path: str, field_id: int, bx: int, by_: int, up: Column | float = 0.0) -> DataFrame:
    """The stored state of one bin; Spark reads its tile only."""
    tile = with_tile(spark.createDataFrame([(field_id, bx, by_)], "field_id int, bx int, by_ int")).first()["tile"]
    return read_field_state(spark, path, up).where((c("field_id") == field_id) & (c("tile") == tile) & (c("bx") == bx) & (c("by_") == by_)).drop("tile")


def metadata(values: DataFrame, names: list[str]) -> DataFrame:
    """(field_id, a column for each of names) from stored pairs (field_id, name, value); null where a field has none."""
    return values.where(c("name").isin(names)).groupBy("field_id").agg(*[F.max(F.when(c("name") == n, c("value"))).alias(n) for n in names])


def stripped(cells: DataFrame, depth: float, coverage_only: bool = False) -> DataFrame:
    """Targets a depth below existing heights over the whole rectangle; missing heights count as 0 unless only covered bins are wanted."""
    got = cells.where("existing IS NOT NULL") if coverage_only else cells
    return got.withColumn("target", F.coalesce("existing", F.lit(0.0)) - depth)


def restored(cells: DataFrame, depth: float, coverage_only: bool = False) -> DataFrame:
    got = cells.where("target IS NOT NULL") if coverage_only else cells
    return got.withColumn("existing", F.coalesce("target", F.lit(0.0)) - depth)


def dem_cells(cells: DataFrame, layer: str) -> DataFrame:
    """(field_id, row_, col, z) with row 0 in the north."""
    top = cells.groupBy("field_id").agg(F.max("by_").alias("top"))
    return cells.join(top, "field_id").select("field_id", (c("top") - c("by_")).alias("row_"), c("bx").alias("col"), c(layer).alias("z"))


def dem_meta(cells: DataFrame, layer: str) -> DataFrame:
    got = cells.groupBy("field_id").agg((F.max("by_") + 1).alias("nrows"), (F.max("bx") + 1).alias("ncols"), F.min(layer).alias("min_z"), F.max(layer).alias("max_z"))
    return got.withColumn("nodata", F.lit(NO_DATA)).withColumn("pixel", F.lit(BIN_M))


def dem_placed(meta: DataFrame, extents: DataFrame) -> DataFrame:
    """meta with the raster's place by its field's extents (min_e, min_n, zone, centroid_lat): its north-west and south-east corners, UTM zone and hemisphere, and the six values of a world file (pixel, rotations, minus pixel, centre of the first cell)."""
    got = meta.join(extents.select("field_id", "min_e", "min_n", "zone", (c("centroid_lat") >= 0).alias("is_north")), "field_id")
    got = got.withColumn("west_e", c("min_e")).withColumn("north_n", c("min_n") + c("nrows") * BIN_M).withColumn("east_e", c("min_e") + c("ncols") * BIN_M).withColumn("south_n", c("min_n"))
    world = F.array(F.lit(BIN_M), F.lit(0.0), F.lit(0.0), F.lit(-BIN_M), c("west_e") + BIN_M / 2, c("north_n") - BIN_M / 2)
    return got.withColumn("world", world).drop("min_e", "min_n")


def latest(rows: DataFrame, keys: list[str], value: str, version: Column) -> DataFrame:
    """Last value of each key by version."""
    return rows.groupBy(*keys).agg(F.max_by(value, version).alias(value))


def numbered(names: DataFrame, text: str, prefix: str) -> DataFrame:
    """Next number of each field after the largest that follows the prefix in text; 1 where there is none."""
    n = F.regexp_extract(c(text), f"(?i){prefix}(\\d+)", 1).try_cast("int")
    return names.groupBy("field_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def place_in_raster(cells: DataFrame, name: str, line: str = "by_", inner: str = "bx") -> DataFrame:
    """cells numbered line by line in each field, from 1: counts by line, then places inside the line, so no field is one task's sort."""
    rows = cells.groupBy("field_id", line).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("field_id").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)) - c("n")
    inside = F.row_number().over(Window.partitionBy("field_id", line).orderBy(inner))
    return cells.withColumn("inside", inside).join(rows.withColumn("before", before).drop("n"), ["field_id", line]).withColumn(name, (c("before") + c("inside")).cast("int")).drop("inside", "before")


def catalogue(files: DataFrame, name: str) -> DataFrame:
    """(folder, name, n_dbs): folders of files (folder, ...) that hold exactly one database, by its name."""
    found = files.groupBy("folder").agg(F.min(name).alias("name"), F.count_distinct(name).alias("n_dbs"))
    return found.where("n_dbs = 1")


def databases(files: DataFrame) -> DataFrame:
    """Files (folder, file) that are databases of fields, with field and version: ``field-V3.db`` is version 3 of field, ``field.db`` its version 0."""
    got = files.where(F.lower("file").endswith(".db")).withColumn("stem", F.regexp_replace("file", "(?i)[.]db$", ""))
    return got.withColumn("field", F.regexp_replace("stem", "-V[0-9]+$", "")).withColumn("version", F.coalesce(F.nullif(F.regexp_extract("stem", "-V([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))).drop("stem")
