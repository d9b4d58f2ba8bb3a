"""Survey elevations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MASTER_ELEVATION_M

c = F.col


def relative_elevations(points: DataFrame, masters: DataFrame, key: str) -> DataFrame:
    """relative_m: elevation less that of the master benchmark (key, master_m) plus 30.48 m; null and flagged without a master."""
    got = points.join(masters, key, "left")
    return got.withColumn("relative_m", c("elevation_m") - c("master_m") + MASTER_ELEVATION_M).withColumn("has_master", c("master_m").isNotNull())


def repaired_elevations(points: DataFrame, key: str) -> DataFrame:
    """Surveys with an elevation over 180.48 m hold absolute ones: all are set relative to an anchor at 30.48 m, the first boundary point, else interior point, else benchmark."""
    rank = F.when(c("kind") == "boundary", 0).when(c("kind") == "interior", 1).otherwise(2)
    anchors = points.groupBy(key).agg((F.max("elevation_m") > MASTER_ELEVATION_M + 150).alias("legacy"), F.min_by("elevation_m", F.struct(rank, "seq")).alias("anchor"))
    got = points.join(anchors, key)
    return got.withColumn("elevation_m", F.when(c("legacy"), c("elevation_m") - c("anchor") + MASTER_ELEVATION_M).otherwise(c("elevation_m"))).drop("legacy", "anchor")
