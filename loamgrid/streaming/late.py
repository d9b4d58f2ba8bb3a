"""Late rows to a table of their own, in front of a stream with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loops import remove

DELAY_MS = 10_000


def split_late(stream: DataFrame, at_ms: str, path: str, delay_ms: int = DELAY_MS) -> DataFrame:
    """Write what is there of a stream to ``path``/on_time and ``path``/late, and return the rows in time as a stream.

    The watermark of a micro-batch is the latest time of earlier ones less delay_ms, as Spark has it, so no operator with
    that watermark drops a row that is in time here. A row without a time is late. A batch that comes again after a
    failure replaces itself, and a call goes on where the last one ended. Rows in time and late ones are all the rows.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        mark = _mark(spark, path, number - 1)
        batch = batch.persist()
        late = F.col(at_ms).isNull() | (F.col(at_ms) < F.lit(mark)) if mark is not None else F.col(at_ms).isNull()
        latest = batch.agg(F.max(F.col(at_ms).cast("long"))).first()[0]
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/b={number}")
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/b={number}")
        marks = [m for m in (mark, None if latest is None else latest - delay_ms) if m is not None]
        spark.createDataFrame([(max(marks) if marks else None,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark/b={number}")
        remove(spark, f"{path}/mark/b={number - 2}")
        batch.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/on_time")


def _mark(spark: SparkSession, path: str, number: int) -> int | None:
    return spark.read.schema("mark long").parquet(f"{path}/mark/b={number}").first()["mark"] if number >= 0 else None


def late_rows(stream: DataFrame, path: str) -> DataFrame:
    """The table of late rows that split_late has left at path."""
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/late")
