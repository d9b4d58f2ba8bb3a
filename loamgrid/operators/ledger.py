"""The ledger of cuts and fills, events and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BIN_M, CY_PER_M3, FILL_RATIO, HEARTBEAT_MS, SWELL

c = F.col
CELL_CY = BIN_M * BIN_M * CY_PER_M3
#: Types of events by the calibration that applies to them. Fixed values.
LATITUDE_TYPES = ("TractorLatitude", "FrontScraperLatitude", "RearScraperLatitude")
LONGITUDE_TYPES = ("TractorLongitude", "FrontScraperLongitude", "RearScraperLongitude")
HEIGHT_TYPES = ("FrontBladeHeight", "RearBladeHeight")
STATS_TYPES = ("CompletedCutCY", "CompletedFillCY")


def load_and_progress(done: DataFrame, swell: float = SWELL) -> DataFrame:
    """done (done, planned in bank yards) with loose yards, percent complete and the remainder."""
    return done.withColumn("loose", c("done") * swell).withColumn("percent", F.when(c("planned") > 0, 100 * c("done") / c("planned"))).withColumn("remaining", c("planned") - c("done"))


def completed_volumes(op_bins: DataFrame) -> DataFrame:
    """Completed cut and fill in cubic yards; fill counts as what it takes of the cut, divided by the ratio."""
    d = c("delta_m")
    return op_bins.groupBy("field_id").agg((F.sum(F.when(d < 0, -d).otherwise(0.0)) * CELL_CY).alias("completed_cut_cy"), (F.sum(F.when(d > 0, d).otherwise(0.0)) * (CELL_CY / FILL_RATIO)).alias("completed_fill_cy"))


def current_heights(initial: DataFrame, op_bins: DataFrame) -> DataFrame:
    """Bins (field_id, bx, by_, initial_m) with current_m and how often each was cut and filled."""
    moved = op_bins.groupBy("field_id", "bx", "by_").agg(F.sum("delta_m").alias("moved_m"), F.count_if(c("delta_m") < 0).alias("n_cuts"), F.count_if(c("delta_m") > 0).alias("n_fills"))
    got = initial.join(moved, ["field_id", "bx", "by_"], "left").fillna({"moved_m": 0.0, "n_cuts": 0, "n_fills": 0})
    return got.withColumn("current_m", c("initial_m") + c("moved_m")).drop("moved_m")


def progress_points(events: DataFrame) -> DataFrame:
    """One row for each time that has a progress event: the largest cut and fill written then."""
    of = lambda t: F.max(F.when(c("type") == t, c("value")))
    return events.where(c("type").isin(*STATS_TYPES)).groupBy("field_id", "ts").agg(of(STATS_TYPES[0]).alias("cut_cy"), of(STATS_TYPES[1]).alias("fill_cy"))


def carried_forward(points: DataFrame) -> DataFrame:
    """Progress points with missing values carried forward in time, from 0."""
    w = Window.partitionBy("field_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    filled = lambda x: F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(0.0)).alias(x)
    return points.select("field_id", "ts", filled("cut_cy"), filled("fill_cy"))


def rate_and_eta(points: DataFrame, planned: DataFrame) -> DataFrame:
    """Cut rate between the first and the last point and hours to go; null unless time and cut have grown."""
    got = points.groupBy("field_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("cut_cy", "ts").alias("c0"), F.max_by("cut_cy", "ts").alias("c1"))
    hours = (F.unix_micros(c("t1").cast("timestamp")) - F.unix_micros(c("t0").cast("timestamp"))) / 3.6e9
    got = got.join(planned, "field_id").withColumn("hours", hours)
    rate = F.when((c("hours") > 0) & (c("c1") > c("c0")), (c("c1") - c("c0")) / c("hours"))
    return got.withColumn("cy_per_hour", rate).withColumn("eta_hours", F.greatest(c("planned_cut_cy") - c("c1"), F.lit(0.0)) / c("cy_per_hour"))


def last_heartbeat(events: DataFrame) -> DataFrame:
    """Time in ms of the last progress event of each field that has any event, 0 for none."""
    ms = F.unix_millis(c("ts").cast("timestamp"))
    return events.groupBy("field_id").agg(F.coalesce(F.max(F.when(c("type").isin(*STATS_TYPES), ms)), F.lit(0)).alias("last_ms"))


def sequence_audit(ops: DataFrame, order: Column | None = None) -> DataFrame:
    """Operations whose number is not one more than the one before: gaps, repeats and steps back, with how many are missing."""
    w = Window.partitionBy("field_id").orderBy(order if order is not None else c("op_no"))
    step = c("op_no") - F.lag("op_no").over(w)
    got = ops.withColumn("step", step).where(c("step").isNotNull() & (c("step") != 1))
    return got.withColumn("problem", F.when(c("step") == 0, "duplicate").when(c("step") < 0, "out of order").otherwise("gap")).withColumn("missing", F.greatest(c("step") - 1, F.lit(0)))


def next_operation(ops: DataFrame) -> DataFrame:
    return ops.groupBy("field_id").agg((F.coalesce(F.max("op_no"), F.lit(0)) + 1).alias("next_op_no"))


def event_class(kind: Column) -> Column:
    """Which calibration an event type gets."""
    return F.when(kind.isin(*LATITUDE_TYPES), "latitude").when(kind.isin(*LONGITUDE_TYPES), "longitude").when(kind.isin(*HEIGHT_TYPES), "height").when(kind.isin(*STATS_TYPES), "statistics").otherwise("none")


def calibrated_events(events: DataFrame, calibration: DataFrame, sign: int = -1) -> DataFrame:
    """Events with value less (sign -1, to store) or plus (sign 1, to read) the calibration of their field (dlat, dlon, dheight); a row a field is joined."""
    kind = event_class(c("type"))
    got = events.join(calibration, "field_id", "left")
    shift = F.when(kind == "latitude", c("dlat")).when(kind == "longitude", c("dlon")).when(kind == "height", c("dheight")).otherwise(0.0)
    return got.withColumn("value", c("value") + sign * F.coalesce(shift, F.lit(0.0))).drop("dlat", "dlon", "dheight")


def running_load(moves: DataFrame) -> DataFrame:
    """moves (machine_id, seq, delta) with load: the running sum that never falls below 0, as the sum less the lowest sum so far."""
    w = Window.partitionBy("machine_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = moves.withColumn("sum_", F.sum("delta").over(w))
    return got.withColumn("load", c("sum_") - F.least(F.lit(0.0), F.min("sum_").over(w))).drop("sum_")


def capacity_alarms(loads: DataFrame, capacity: float) -> DataFrame:
    """The first row of each time that the load is at capacity: it was below before."""
    before = F.coalesce(F.lag("load").over(Window.partitionBy("machine_id").orderBy("seq")), F.lit(0.0))
    return loads.withColumn("before", before).where((c("load") >= capacity) & (c("before") < capacity)).drop("before")


def settled(rows: DataFrame, last: DataFrame, applied: DataFrame) -> DataFrame:
    """rows with status (applied, waiting, quarantine): operations (field_id, op_no, op_id) that came in or waited, by what is applied before: last (field_id, last_no), and the ledger itself.

    Of each number one operation counts, the one applied or, if none is, that with the smallest op_id. The same operation
    again is dropped; another one by its number goes to quarantine. Numbers that follow on from the last one apply, up to the
    first gap; those behind it wait until the gap closes, however many batches that takes.
    """
    got = rows.join(last, "field_id", "left").withColumn("last_no", F.coalesce("last_no", F.lit(0))).dropDuplicates(["field_id", "op_no", "op_id"])
    again = got.where(c("op_no") <= c("last_no")).drop("last_no")
    same = ["field_id", "op_no", "op_id"]
    against_ledger = again.join(applied.select(*same).distinct(), same, "left_anti")
    new = got.where(c("op_no") > c("last_no")).withColumn("choice", F.row_number().over(Window.partitionBy("field_id", "op_no").orderBy("op_id")))
    against_new = new.where("choice > 1").drop("last_no", "choice")
    # A field's first gap is the smallest number that none has and whose predecessor is there or applied; no task gets a field.
    chosen = new.where("choice = 1").drop("choice")
    there = chosen.select("field_id", c("op_no").cast("long").alias("op_no"))
    after = there.unionByName(chosen.select("field_id", c("last_no").alias("op_no")).distinct()).select("field_id", (c("op_no") + 1).alias("op_no"))
    gaps = after.join(there, ["field_id", "op_no"], "left_anti").groupBy("field_id").agg(F.min("op_no").alias("gap"))
    chosen = chosen.join(gaps, "field_id").withColumn("fits", c("op_no") < c("gap")).drop("last_no", "gap")
    told = chosen.withColumn("status", F.when(c("fits"), "applied").otherwise("waiting")).drop("fits")
    return told.unionByName(against_ledger.unionByName(against_new).withColumn("status", F.lit("quarantine")))


def heartbeats(events: DataFrame, gap_ms: int = HEARTBEAT_MS) -> DataFrame:
    """Times at which totals are written: the first event of a field, then the first one at least gap_ms after the last write.

    The rule is a chain (each write depends on the last): a row knows its successor by a range look-up, and the chain
    from each field's first row is followed by doubling, so no field is walked row by row.
    """
    ms = events.groupBy("field_id", "ms").agg(F.count("*").alias("n_events"))
    buckets = ms.withColumn("bucket", F.floor(c("ms") / gap_ms))
    # The successor is the first row in bucket(ms + gap) at or after it, else the first row of the next bucket that has any.
    firsts = buckets.groupBy("field_id", "bucket").agg(F.min("ms").alias("first_ms"))
    firsts = firsts.withColumn("later", F.lead("first_ms").over(Window.partitionBy("field_id").orderBy("bucket")))
    from_ms = c("ms") + gap_ms
    inside = buckets.select("field_id", "ms", (c("bucket") + 1).alias("bucket")).join(buckets.select("field_id", "bucket", c("ms").alias("m2")), ["field_id", "bucket"]).where(c("m2") >= from_ms).groupBy("field_id", "ms").agg(F.min("m2").alias("hit"))
    nxt = firsts.select("field_id", c("bucket").alias("b"), "later")
    # Last bucket with rows up to ms + gap: its successor's first row.
    known = buckets.select("field_id", "ms", (c("bucket") + 1).alias("b"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("later")).unionByName(nxt.select("field_id", F.lit(None).cast("long").alias("ms"), "b", F.lit(0).alias("ask"), "later"))
    w = Window.partitionBy("field_id").orderBy("b", "ask").rowsBetween(Window.unboundedPreceding, 0)
    later = known.withColumn("later", F.last(F.when(c("ask") == 0, F.struct("later")), ignorenulls=True).over(w)["later"]).where("ask = 1").select("field_id", "ms", "later")
    succ = ms.join(inside, ["field_id", "ms"], "left").join(later, ["field_id", "ms"], "left").select("field_id", "ms", F.coalesce("hit", "later").alias("next"))
    return _chain(succ, ms)


def _chain(succ: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows on the chain from each field's smallest ms, by doubling: in each round every row on the chain adds the row 2^k steps on."""
    from .loops import cut

    on = succ.groupBy("field_id").agg(F.min("ms").alias("ms"))
    jump = cut(succ)
    on = cut(on)
    while True:
        more = on.join(jump.where("next IS NOT NULL"), ["field_id", "ms"]).select("field_id", c("next").alias("ms"))
        after = cut(on.unionByName(more).distinct())
        on = after
        if jump.where("next IS NOT NULL").isEmpty():
            break
        two = jump.select("field_id", c("ms").alias("next"), c("next").alias("next2"))
        jump = cut(jump.join(two, ["field_id", "next"], "left").select("field_id", "ms", c("next2").alias("next")))
    return rows.join(on, ["field_id", "ms"], "left_semi").select("field_id", "ms")
