"""Queries on stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.loops import shared_dir
from .base import query, view

c = F.col


@query("S07_benchmarks_and_arrows", "SELECT field_id, name AS id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(elevation_m, 6) AS value FROM v_benchmarks UNION ALL SELECT field_id, 'arrow' || seq, round(lat, 8), round(lon, 8), direction_deg FROM v_haul", "v_benchmarks v_haul")
def s07(spark, sf) -> DataFrame:
    """Both tables written and read again, a folder a field."""
    base = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"
    marks = view(spark, sf, "v_benchmarks").select("field_id", c("name").alias("id"), "lat", "lon", c("elevation_m").alias("value"))
    arrows = view(spark, sf, "v_haul").select("field_id", F.concat(F.lit("arrow"), c("seq").cast("string")).alias("id"), "lat", "lon", c("direction_deg").alias("value"))
    for name, df in (("benchmarks", marks), ("arrows", arrows)):
        df.write.partitionBy("field_id").parquet(f"{base}/{name}")
    got = spark.read.parquet(f"{base}/benchmarks").unionByName(spark.read.parquet(f"{base}/arrows"))
    return got.select("field_id", "id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("value", 6).alias("value"))


