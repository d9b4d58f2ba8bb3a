"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, read, set_aside, word_count

#: Weights by place of the source in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all sizes, and the most that a source or document may be repeated.
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets share ``total_share`` of all sizes by weight, each at most ``most`` times its source's size; what is cut
    off goes to the others by weight until none is above. In closed form: with sources in order of cap / weight, the
    common level is (total - caps before) / (weights from here on) at the first source whose ratio is not below it.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    per = per.withColumn("w_after", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * total_share - F.col("caps_before")) / F.col("w_after"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs (doc_id, text, source, any others) with __size, __source_size, __target and __copies.

    A document is taken floor(target / source_size) times and once more if its number in [0, 1), the first 52 bits of
    the MD5 of seed and doc_id, is below the fraction. So reruns agree, and repeated rows of one doc_id decide alike.
    Null text: size 0; whole texts count, however long. A null source is a source, last in order; a source of size 0
    has target 0. An empty table gives an empty result. Columns of docs by the added names are replaced.
    """
    docs = docs.drop("__size", "__source", "__source_size", "__target", "__copies").withColumn("__size", word_count(F.col("text")))
    targets = source_targets(docs.select("source", F.col("__size").alias("size")), **how)
    targets = targets.toDF("__source", "__source_size", "__target")
    targets = checked_broadcast(targets, docs.select("source").distinct().count())
    got = docs.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    once_more = F.conv(digits, 16, 10).cast("double") / float(1 << 52) < rate - F.floor(rate)
    return got.withColumn("__copies", (F.floor(rate) + once_more.cast("long")).cast("long"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    docs, columns = set_aside(docs, "__size", "__source", "__source_size", "__target", "__copies", "__copy")
    taken = with_copies(docs, **how).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_copies(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source),
p AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 ELSE 2.0e0 END AS w, source_size * 2.0e0 AS cap FROM s),
r AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS caps_before,
  sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after,
  CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS total FROM p),
l AS (SELECT *, (total - caps_before) / w_after AS level FROM r),
m AS (SELECT min_by(level, cap / w) AS level FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, least(coalesce(m.level * w, cap), cap) AS target FROM p LEFT JOIN m ON true),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0e0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0e0 < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
