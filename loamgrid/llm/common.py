"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator of words: space, tab, line feed, vertical tab, form feed, carriage return.
#: Python's ``bytes.split()`` splits at exactly these.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows up to which a counted table may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 50_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in tests, a new local one, but only if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-loamgrid-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of each query that ends meanwhile: what was written needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: this cuts the lineage and survives lost executors. The shuffle files of the write go when it ends."""
    path = new_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._loamgrid_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        spark, path = t.sparkSession, t._loamgrid_path
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with columns by these names, which an operator needs for its own work, called otherwise; and the columns that give df's own names back."""
    other = {c: c + "_of_the_input" if c in names else c for c in df.columns}
    return df.withColumnsRenamed({c: o for c, o in other.items() if c != o}), [F.col(o).alias(c) for c, o in other.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checked_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose rows have been counted, if there are few; else leave the join to Spark."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def word_count(text: Column) -> Column:
    """Words of a text; null has none. Splits at SPACES and takes off the empty ends."""
    parts = F.split(text, SPACES)
    ends = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.coalesce(F.size(parts).cast("long") - ends, F.lit(0).cast("long"))


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long) by alternating stars (Kiveris et al. 2014).

    Returns (id, component) for every id in an edge, component being the smallest id reachable. Each round shuffles the
    edges only and leaves them in the shared folder; hot nodes meet in plain joins, which Spark can split.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))

    def mirrored(e: DataFrame) -> DataFrame:
        return e.select(F.explode(both).alias("e")).select("e.u", "e.v")

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    now = staged(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), label)
    said = told(now)
    for _ in range(max_rounds):
        if not said[0]:
            break
        m = mirrored(now)
        low = m.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = m.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = staged(small, label)
        discard(now)
        now, before = after, said
        said = told(now)
        if said == before:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

