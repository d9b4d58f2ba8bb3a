"""Text sources: point files, surveys, haul samples, receiver logs, overlay footprints. All columns are read as text and cast with care; bad rows are kept apart, not dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid

c = F.col


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line) of text files; one row a file is split, so files are of the size of a survey."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).where(F.trim("line") != "")


def _field(k: int) -> Column:
    return F.trim(F.try_element_at(F.split("line", ","), F.lit(k)))


def points_strict(lines: DataFrame) -> DataFrame:
    """Point files with seven fields behind a heading: kind (point or benchmark, by MB or BM in the code), heights of 0 left out, cut/fill with its sign turned, or existing less target where it is blank or 0.000."""
    got = lines.where((c("seq") > 0) & (F.size(F.split("line", ",")) >= 7))
    got = got.select("file", "seq", _field(1).try_cast("double").alias("lat"), _field(2).try_cast("double").alias("lon"), _field(3).try_cast("double").alias("existing"), _field(4).try_cast("double").alias("target"), _field(5).alias("cutfill"), _field(6).alias("code"), _field(7).alias("comment"))
    mark = F.upper("code").contains("MB") | F.upper("code").contains("BM")
    got = got.withColumn("kind", F.when(mark, "benchmark").otherwise("point")).where(mark | ((c("existing") != 0) & (c("target") != 0)))
    return got.withColumn("cutfill_m", F.when(F.coalesce("cutfill", F.lit("")).isin("", "0.000"), c("existing") - c("target")).otherwise(-c("cutfill").try_cast("double"))).drop("cutfill")


def points_lenient(lines: DataFrame) -> DataFrame:
    """Point files with at least four fields; name and code tell benchmarks; rows without both heights are left out, zeros stay."""
    got = lines.where(F.size(F.split("line", ",")) >= 4)
    token = F.upper(F.concat_ws(" ", _field(5), _field(6)))
    got = got.select("file", "seq", _field(1).try_cast("double").alias("lat"), _field(2).try_cast("double").alias("lon"), _field(3).try_cast("double").alias("existing"), _field(4).try_cast("double").alias("target"), F.when(token.contains("MB") | token.contains("BM"), "benchmark").otherwise("point").alias("kind"))
    return got.where("lat IS NOT NULL AND lon IS NOT NULL AND existing IS NOT NULL AND (target IS NOT NULL OR kind = 'benchmark')")


def survey(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of survey files lat,lon,elevation[,code]: codes with mb are the master, with bm benchmarks, 2PER boundary, others interior. One heading row is let pass."""
    got = lines.select("file", "seq", _field(1).try_cast("double").alias("lat"), _field(2).try_cast("double").alias("lon"), _field(3).try_cast("double").alias("elevation_m"), F.coalesce(_field(4), F.lit("")).alias("code"), "line")
    code = F.lower("code")
    kind = F.when(code.contains("mb"), "master").when(code.contains("bm"), "benchmark").when(F.upper("code") == "2PER", "boundary").otherwise("interior")
    good = c("lat").isNotNull() & c("lon").isNotNull() & c("elevation_m").isNotNull()
    return got.where(good).withColumn("kind", kind).drop("line"), got.where(~good & (c("seq") > 0)).select("file", "seq", "line")


def survey_lines(rows: DataFrame) -> DataFrame:
    """Survey rows (file, kind, seq) as lines: master, benchmarks, boundary, interior, each in its order."""
    rank = F.when(c("kind") == "master", 0).when(c("kind") == "benchmark", 1).when(c("kind") == "boundary", 2).otherwise(3)
    code = F.when(c("kind") == "boundary", "2PER").when(c("kind") == "interior", "3GRD").otherwise(c("code"))
    got = rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy(rank, "seq")).alias("line_no"), F.format_string("%.8f,%.8f,%.4f,%s", "lat", "lon", "elevation_m", code).alias("line"))
    return got.repartition("file").sortWithinPartitions("file", "line_no")


def multiplane(lines: DataFrame) -> DataFrame:
    """Surveys as offsets from a master benchmark: the first line has its elevation and ``MB <lat> / <lon>``, others id, east, north, elevation and code, tab-separated, in feet unless the file's name has ``_m``."""
    tab = lambda k: F.trim(F.try_element_at(F.split("line", "\t"), F.lit(k)))
    unit = F.when(F.lower("file").contains("_m"), 1.0).otherwise(0.3048)
    place = F.regexp_replace(tab(5), "^\\s*MB\\s*", "")
    head = lines.where("seq = 0").select("file", geo.dms_to_degrees(F.trim(F.split_part(place, F.lit("/"), F.lit(1)))).alias("lat0"), geo.dms_to_degrees(F.trim(F.split_part(place, F.lit("/"), F.lit(2)))).alias("lon0"), tab(2).try_cast("double").alias("de0"), tab(3).try_cast("double").alias("dn0"), (tab(4).try_cast("double") * unit).alias("elevation0_m"))
    body = lines.where("seq > 0").select("file", "seq", (tab(2).try_cast("double") * unit).alias("de"), (tab(3).try_cast("double") * unit).alias("dn"), (tab(4).try_cast("double") * unit).alias("elevation_m"), F.upper(F.coalesce(tab(5), F.lit(""))).alias("code"))
    got = body.where("de IS NOT NULL AND dn IS NOT NULL").join(head, "file")
    got = grid.shifted(got.withColumns({"lat": c("lat0"), "lon": c("lon0")}), c("de") - F.coalesce(c("de0") * unit, F.lit(0.0)), c("dn") - F.coalesce(c("dn0") * unit, F.lit(0.0)))
    kind = F.when(c("code") == "B", "boundary").when(c("code").startswith("MB"), "master").when(c("code").startswith("BM"), "benchmark").otherwise("interior")
    return got.select("file", "seq", "lat", "lon", "elevation_m", kind.alias("kind"), "code")


def multiplane_lines(rows: DataFrame, masters: DataFrame) -> DataFrame:
    """Survey rows as lines in feet from their master (file, e0, n0): ids from 2, master first."""
    got = rows.join(masters, "file").withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy(F.when(c("kind") == "master", 0).when(c("kind") == "benchmark", 1).when(c("kind") == "boundary", 2).otherwise(3), "seq")) + 1)
    return got.select("file", "line_no", F.format_string("%d\t%.3f\t%.3f\t%.3f\t%s", c("line_no"), geo.m_to_feet(c("e") - c("e0")), geo.m_to_feet(c("n") - c("n0")), geo.m_to_feet(c("elevation_m")), "code").alias("line"))


def haul_samples(lines: DataFrame) -> DataFrame:
    """lat,lon,direction[,source]; rows that are no numbers go."""
    got = lines.select("file", "seq", _field(1).try_cast("double").alias("lat"), _field(2).try_cast("double").alias("lon"), _field(3).try_cast("double").alias("direction_deg"), _field(4).alias("source"))
    return got.where("lat IS NOT NULL AND lon IS NOT NULL AND direction_deg IS NOT NULL")


def _angle(value: Column, hemisphere: Column, degrees: int, most: float) -> Column:
    """ddmm.mmmm as degrees; null beyond its range."""
    d = F.substring(value, 1, degrees).try_cast("double") + F.substring(value, degrees + 1, 20).try_cast("double") / 60
    d = F.when(hemisphere.isin("S", "W"), -d).otherwise(d)
    return F.when(F.abs(d) <= most, d)


def receiver_log(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, vectors, rejects) of lines (machine_id, seq, line): GGA position and VTG course sentences of any talker, cut at the checksum's ``*``. Quality 4 is Fix, 5 Float, 0 no fix."""
    p = F.split(F.split_part("line", F.lit("*"), F.lit(1)), ",")
    at = lambda k: F.try_element_at(p, F.lit(k + 1))
    got = lines.withColumn("sentence", F.substring(at(0), 4, 3)).withColumn("from_receiver", at(0).rlike("^\\$G[A-Z]"))
    gga, vtg = c("from_receiver") & (c("sentence") == "GGA"), c("from_receiver") & (c("sentence") == "VTG")
    quality = at(6).try_cast("int")
    fixes = got.where(gga).select(
        "machine_id", "seq", _angle(at(2), at(3), 2, 90.0).alias("lat"), _angle(at(4), at(5), 3, 180.0).alias("lon"), at(9).try_cast("double").alias("altitude_m"), F.when(quality == 4, "Fix").when(quality == 5, "Float").otherwise("None").alias("rtk"),
        (F.substring(at(1), 1, 2).try_cast("int") * 3600000 + F.substring(at(1), 3, 2).try_cast("int") * 60000 + (F.substring(at(1), 5, 10).try_cast("double") * 1000)).cast("long").alias("day_ms"), "line",
    )
    vectors = got.where(vtg).select("machine_id", "seq", at(1).try_cast("double").alias("track_deg"), at(7).try_cast("double").alias("speed_kph"))
    bad = fixes.where("lat IS NULL OR lon IS NULL").select("machine_id", "seq", "line").unionByName(got.where(~F.coalesce(gga | vtg, F.lit(False))).select("machine_id", "seq", "line"))
    return fixes.where("lat IS NOT NULL AND lon IS NOT NULL").drop("line"), vectors.where("track_deg IS NOT NULL AND speed_kph IS NOT NULL"), bad


def footprints(overlays: DataFrame, images: DataFrame) -> DataFrame:
    """Bounding boxes of overlays (file, text) with a coordinate list ``lon,lat,alt ...``, for the images (file) of the same stem."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    spots = overlays.select(stem.alias("stem"), F.explode(F.split(F.trim(F.regexp_extract("text", r"(?s)<coordinates>(.*?)</coordinates>", 1)), r"\s+")).alias("spot"))
    xy = spots.select("stem", F.split_part("spot", F.lit(","), F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(F.split("spot", ","), F.lit(2)).try_cast("double").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    box = xy.groupBy("stem").agg(F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.min("lon").alias("west"))
    return images.select(stem.alias("stem"), c("file").alias("image")).join(box, "stem")


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, file, length, modified) of all files under a folder, by their names only: contents are not opened. folder is the path below root."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.lit(len(root.split("://")[-1].rstrip("/").lstrip("/").split("/")))
    inner = F.regexp_replace("path", "^[a-z0-9]+:/+", "")
    names = F.split(inner, "/")
    return listed.select(F.array_join(F.slice(names, base + 1, F.size(names) - base - 1), "/").alias("folder"), F.element_at(names, -1).alias("file"), "length", c("modificationTime").alias("modified"))
