"""Loops of DataFrame steps that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, as in tests, a new local folder, but only if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-loamgrid-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads, if it is there."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder."""
    fs, at = _folder(spark, path)
    there = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(there.getParent())
    if not fs.rename(at, there):
        raise OSError(f"could not move {path} to {to}")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows up to which a counted table of short rows is broadcast; beyond it the join is left to Spark.
FEW_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """A table of short rows, such as one a field, written out and counted: broadcast if there are few, else joined as Spark chooses."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str = "changed", max_rounds: int = 200) -> DataFrame:
    """Repeat step until no row says that it changed. step returns the columns of state and the flag ``changed``.

    A round costs one checkpoint and one flag read by the driver; the state keeps its size.
    """
    state = cut(state)
    for _ in range(max_rounds):
        after = cut(step(state))
        state = after.drop(changed)
        if after.where(changed).isEmpty():
            return state
    raise RuntimeError("the loop did not settle")


def by_blocks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 64, halo: int = 1) -> DataFrame:
    """Apply fn to blocks of size x size cells (field_id, bx, by_), each with the cells of its neighbours within halo.

    fn gets a column ``own`` and returns rows for its own cells only. Work and memory of a task are those of a block,
    however large the field is.
    """
    side = lambda c: F.expr(f"transform(sequence(cast(floor(({c} - {halo}) / {size}.0) as int), cast(floor(({c} + {halo}) / {size}.0) as int)), x -> x)")
    spread = df.withColumn("block_x", F.explode(side("bx"))).withColumn("block_y", F.explode(side("by_")))
    spread = spread.withColumn("own", (F.floor(F.col("bx") / float(size)) == F.col("block_x")) & (F.floor(F.col("by_") / float(size)) == F.col("block_y")))
    return spread.groupBy("field_id", "block_x", "block_y").applyInPandas(lambda pdf: fn(pdf) if pdf["own"].any() else fn(pdf.iloc[:0]), schema)


def walked(rows: DataFrame, keys: list[str], order: str, output: str | StructType, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, list[tuple]]], finish: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows of each key in order through step(state, row) -> (state, rows out), and finish(state) -> rows out behind the last.

    Rows are sorted by Spark and come in batches, so a task holds one batch and one state, however many rows a key has.
    """
    names = output.fieldNames() if isinstance(output, StructType) else [x.split()[0] for x in output.split(", ")]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, begun = start(), None, False
        for pdf in frames:
            out: list[tuple] = []
            for key, row in zip(pdf[keys].itertuples(index=False, name=None), pdf.itertuples(index=False), strict=True):
                if not begun or key != last:
                    if begun and finish:
                        out += finish(now)
                    now, last, begun = start(), key, True
                now, more = step(now, row)
                out += more
            yield pd.DataFrame(out, columns=names)
        if begun and finish:
            yield pd.DataFrame(finish(now), columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(walk, output)
