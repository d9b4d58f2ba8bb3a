"""Queries on the ledger, events and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FILL_RATIO
from ..operators import ledger, tables
from ..streaming import live
from .base import query, rounded, view
from .grid import _CY

c = F.col


@query("A05_completed_volumes", f"SELECT field_id, round(sum(CASE WHEN delta_m < 0 THEN -delta_m ELSE 0 END) * {_CY}, 4) AS completed_cut_cy, round(sum(CASE WHEN delta_m > 0 THEN delta_m ELSE 0 END) * {_CY} / {FILL_RATIO}e0, 4) AS completed_fill_cy FROM v_op_bins GROUP BY field_id", "v_op_bins")
def a05(spark, sf) -> DataFrame:
    return rounded(ledger.completed_volumes(view(spark, sf, "v_op_bins")))


_INITIAL = "WITH i AS (SELECT f.field_id, g.bx, g.by_, g.z AS initial_m FROM v_grid g, (SELECT DISTINCT field_id FROM v_op_bins) f)\n"


def _initial(spark, sf) -> DataFrame:
    cells = view(spark, sf, "v_grid").drop("field_id").withColumn("field_id", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return cells.select("field_id", "bx", "by_", c("z").alias("initial_m"))


@query(
    "A09_current_heights",
    _INITIAL + "SELECT i.field_id, i.bx, i.by_, round(initial_m + coalesce(sum(delta_m), 0), 6) AS current_m, count(*) FILTER (delta_m < 0) AS n_cuts, count(*) FILTER (delta_m > 0) AS n_fills FROM i LEFT JOIN v_op_bins d ON i.field_id = d.field_id AND i.bx = d.bx AND i.by_ = d.by_ GROUP BY i.field_id, i.bx, i.by_, initial_m",
    "v_grid v_op_bins",
)
def a09(spark, sf) -> DataFrame:
    return rounded(ledger.current_heights(_initial(spark, sf), view(spark, sf, "v_op_bins")).select("field_id", "bx", "by_", "current_m", "n_cuts", "n_fills"), 6)


_POINTS = "SELECT field_id, ts, max(CASE WHEN type = 'CompletedCutCY' THEN value END) AS cut_cy, max(CASE WHEN type = 'CompletedFillCY' THEN value END) AS fill_cy FROM v_eav WHERE type IN ('CompletedCutCY', 'CompletedFillCY') GROUP BY field_id, ts"
_CARRIED = f"WITH p AS ({_POINTS}), f AS (SELECT field_id, ts, coalesce(last_value(cut_cy IGNORE NULLS) OVER w, 0) AS cut_cy, coalesce(last_value(fill_cy IGNORE NULLS) OVER w, 0) AS fill_cy FROM p WINDOW w AS (PARTITION BY field_id ORDER BY ts ROWS UNBOUNDED PRECEDING))\n"


@query("A10_progress_pivot", _POINTS, "v_eav")
def a10(spark, sf) -> DataFrame:
    return ledger.progress_points(view(spark, sf, "v_eav"))


@query("W01_carry_forward", _CARRIED + "SELECT * FROM f", "v_eav")
def w01(spark, sf) -> DataFrame:
    return ledger.carried_forward(ledger.progress_points(view(spark, sf, "v_eav")))


@query(
    "A11_rate_and_eta",
    _CARRIED + """, r AS (SELECT field_id, min(ts) AS t0, max(ts) AS t1, min_by(cut_cy, ts) AS c0, max_by(cut_cy, ts) AS c1 FROM f GROUP BY field_id),
h AS (SELECT *, (epoch_us(t1) - epoch_us(t0)) / 3.6e9 AS hours FROM r), k AS (SELECT *, CASE WHEN hours > 0 AND c1 > c0 THEN (c1 - c0) / hours END AS rate FROM h)
SELECT field_id, round(hours, 4) AS hours, round(rate, 6) AS cy_per_hour, round(greatest(500 - c1, 0) / rate, 4) AS eta_hours FROM k""",
    "v_eav",
)
def a11(spark, sf) -> DataFrame:
    points = ledger.carried_forward(ledger.progress_points(view(spark, sf, "v_eav")))
    planned = points.select("field_id").distinct().withColumn("planned_cut_cy", F.lit(500.0))
    got = ledger.rate_and_eta(points, planned)
    return got.select("field_id", F.round("hours", 4).alias("hours"), F.round("cy_per_hour", 6).alias("cy_per_hour"), F.round("eta_hours", 4).alias("eta_hours"))


@query("A12_last_heartbeat", "SELECT field_id, coalesce(max(CASE WHEN type IN ('CompletedCutCY', 'CompletedFillCY') THEN epoch_us(ts) // 1000 END), 0) AS last_ms FROM v_eav GROUP BY field_id", "v_eav")
def a12(spark, sf) -> DataFrame:
    return ledger.last_heartbeat(view(spark, sf, "v_eav"))


_OPS = "WITH o AS (SELECT field_id, op_id, op_id // 4 + 1 AS op_no FROM v_ops WHERE op_id % 97 <> 5)\n"


def _ops(spark, sf) -> DataFrame:
    return view(spark, sf, "v_ops").where("op_id % 97 <> 5").withColumn("op_no", F.expr("op_id div 4 + 1"))


@query("A13_sequence_audit", _OPS + ", s AS (SELECT *, op_no - lag(op_no) OVER (PARTITION BY field_id ORDER BY op_no) AS step FROM o) SELECT field_id, op_id, op_no, step, CASE WHEN step = 0 THEN 'duplicate' WHEN step < 0 THEN 'out of order' ELSE 'gap' END AS problem, greatest(step - 1, 0) AS missing FROM s WHERE step <> 1", "v_ops")
def a13(spark, sf) -> DataFrame:
    return ledger.sequence_audit(_ops(spark, sf)).select("field_id", "op_id", "op_no", "step", "problem", "missing")


@query("A13_next_operation", _OPS + "SELECT field_id, max(op_no) + 1 AS next_op_no FROM o GROUP BY field_id", "v_ops")
def a13n(spark, sf) -> DataFrame:
    return ledger.next_operation(_ops(spark, sf))


@query("A14_benchmark_number", "SELECT field_id, CAST(max(CAST(regexp_extract(name, '(\\d+)$', 1) AS INT)) + 1 AS INT) AS next FROM v_benchmarks GROUP BY field_id", "v_benchmarks")
def a14(spark, sf) -> DataFrame:
    marks = view(spark, sf, "v_benchmarks").withColumn("name", F.concat(F.lit("BM"), F.regexp_extract("name", "(\\d+)$", 1)))
    return tables.numbered(marks, "name", "BM")


@query("A15_version_number", "SELECT field_id, CAST(max(op_id % 40) + 1 AS INT) AS next FROM v_ops GROUP BY field_id", "v_ops")
def a15(spark, sf) -> DataFrame:
    files = view(spark, sf, "v_ops").withColumn("file", F.concat(F.lit("field-V"), (c("op_id") % 40).cast("string"), F.lit(".db")))
    return tables.numbered(files, "file", "-V")


#: Each operation's database lies in a folder of its field; those of every 31st lie in another field's.
_FILES = "SELECT CAST(floor(op_id / 40.0e0) AS BIGINT) * 4 + CASE WHEN op_id % 31 = 0 THEN (field_id + 1) % 4 ELSE field_id END AS folder, field_id FROM v_ops"


@query("A21_catalogue", f"SELECT folder, min(field_id) AS field_id, count(DISTINCT field_id) AS n_dbs FROM ({_FILES}) GROUP BY folder HAVING count(DISTINCT field_id) = 1", "v_ops")
def a21(spark, sf) -> DataFrame:
    """Folders that hold the database of one field only; many hold a second one. tables.catalogue does this for a real tree."""
    files = spark.sql(_FILES.replace("FROM v_ops", "FROM {v}"), v=view(spark, sf, "v_ops"))
    return tables.catalogue(files, "field_id").select("folder", c("name").alias("field_id"), "n_dbs")


@query("F15_event_classes", "SELECT field_id, event_id, CASE WHEN type = 'FrontBladeHeight' THEN 'height' WHEN type LIKE 'Completed%' THEN 'statistics' ELSE 'none' END AS class FROM v_eav", "v_eav")
def f15(spark, sf) -> DataFrame:
    return view(spark, sf, "v_eav").select("field_id", "event_id", ledger.event_class(c("type")).alias("class"))


@query("S08_calibrated_events", "SELECT field_id, event_id, ts, type, round(CASE WHEN type = 'FrontBladeHeight' THEN value - field_id * 0.1e0 ELSE value END, 6) AS value FROM v_eav", "v_eav")
def s08(spark, sf) -> DataFrame:
    events = view(spark, sf, "v_eav")
    shifts = events.select("field_id").distinct().select("field_id", F.lit(0.0).alias("dlat"), F.lit(0.0).alias("dlon"), (c("field_id") * 0.1).alias("dheight"))
    return rounded(ledger.calibrated_events(events, shifts).select("field_id", "event_id", "ts", "type", "value"), 6)


_LAST = "SELECT field_id, type, max_by(value, (epoch_us(ts), event_id)) AS value FROM v_eav GROUP BY field_id, type"


@query("S09_metadata", f"WITH l AS ({_LAST}) SELECT field_id, max(CASE WHEN type = 'Speedkph' THEN value END) AS speed, max(CASE WHEN type = 'Heading' THEN value END) AS heading, max(CASE WHEN type = 'FrontBladeHeight' THEN value END) = 1 AS flag FROM l GROUP BY field_id", "v_eav")
def s09(spark, sf) -> DataFrame:
    last = tables.latest(view(spark, sf, "v_eav"), ["field_id", "type"], "value", F.struct("ts", "event_id"))
    wide = last.groupBy("field_id").pivot("type", ["Speedkph", "Heading", "FrontBladeHeight"]).agg(F.first("value"))
    return wide.select("field_id", c("Speedkph").alias("speed"), c("Heading").alias("heading"), (c("FrontBladeHeight") == 1).alias("flag"))


@query("T01_events_by_time", "SELECT field_id, event_id, row_number() OVER (PARTITION BY field_id ORDER BY ts, event_id) AS place FROM v_eav", "v_eav")
def t01(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    return view(spark, sf, "v_eav").select("field_id", "event_id", F.row_number().over(Window.partitionBy("field_id").orderBy("ts", "event_id")).alias("place"))


@query("T04_single_lookup", f"WITH l AS ({_LAST}) SELECT value FROM l WHERE field_id = 1 AND type = 'Speedkph' LIMIT 1", "v_eav")
def t04(spark, sf) -> DataFrame:
    last = tables.latest(view(spark, sf, "v_eav").where("field_id = 1 AND type = 'Speedkph'"), ["field_id", "type"], "value", F.struct("ts", "event_id"))
    return last.select("value").limit(1)


_MOVES = "WITH m AS (SELECT op_id % 8 AS machine_id, op_id * 10 + row_number() OVER (PARTITION BY op_id ORDER BY bx, by_, delta_m) AS seq, -delta_m AS delta FROM v_op_bins), s AS (SELECT *, sum(delta) OVER w AS s FROM m WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS UNBOUNDED PRECEDING)), l AS (SELECT machine_id, seq, round(s - least(0, min(s) OVER w), 6) AS load FROM s WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS UNBOUNDED PRECEDING))\n"


def loads(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("op_id").orderBy("bx", "by_", "delta_m"))
    moves = view(spark, sf, "v_op_bins").select((c("op_id") % 8).alias("machine_id"), (c("op_id") * 10 + place).alias("seq"), (-c("delta_m")).alias("delta"))
    return ledger.running_load(moves).select("machine_id", "seq", F.round("load", 6).alias("load"))


@query("W15_running_load", _MOVES + "SELECT * FROM l", "v_op_bins")
def w15(spark, sf) -> DataFrame:
    return loads(spark, sf)


_ALARMS = _MOVES + ", b AS (SELECT *, coalesce(lag(load) OVER (PARTITION BY machine_id ORDER BY seq), 0) AS before FROM l) SELECT machine_id, seq, load FROM b WHERE load >= 1.005 AND before < 1.005"


@query("W16_capacity_crossings", _ALARMS, "v_op_bins")
def w16(spark, sf) -> DataFrame:
    return ledger.capacity_alarms(loads(spark, sf), 1.005)


@query("R10_load_alarms", _ALARMS, "v_op_bins")
def r10(spark, sf) -> DataFrame:
    return ledger.capacity_alarms(loads(spark, sf), 1.005)


@query("W14_state_changes", "WITH p AS (SELECT machine_id, event_id, fast_ms, rtk, lag(rtk) OVER (PARTITION BY machine_id ORDER BY fast_ms) AS old FROM v_fixes) SELECT machine_id, event_id, fast_ms, old, rtk AS new FROM p WHERE old <> rtk", "v_fixes")
def w14(spark, sf) -> DataFrame:
    from ..operators import gnss

    return gnss.changes(view(spark, sf, "v_fixes"), "rtk").select("machine_id", "event_id", "fast_ms", "old", "new")


#: Operations of four fields, numbered from 1, of which every 4000th never comes; some come twice, some numbers come with two operations.
_CHAIN = """SELECT field_id, op_id, op_no, (op_id * 7919) % 1000 AS arrives FROM (SELECT field_id, op_id, row_number() OVER (PARTITION BY field_id ORDER BY op_id) AS op_no FROM v_ops) WHERE op_no % 4000 <> 3999"""
_ARRIVALS = f"""SELECT * FROM ({_CHAIN}) UNION ALL SELECT field_id, op_id, op_no, 999 AS arrives FROM ({_CHAIN}) WHERE op_id % 11 = 0 UNION ALL SELECT field_id, op_id + 1000000000 AS op_id, op_no, 1001 AS arrives FROM ({_CHAIN}) WHERE op_id % 13 = 0"""


@query(
    "R11_ledger_commit",
    f"""WITH a AS ({_ARRIVALS}), k AS (SELECT DISTINCT field_id, op_id, op_no FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY field_id, op_no ORDER BY op_id) AS choice, dense_rank() OVER (PARTITION BY field_id ORDER BY op_no) AS place FROM k)
SELECT field_id, op_id, op_no, CASE WHEN choice > 1 THEN 'quarantine' WHEN op_no = place THEN 'applied' ELSE 'waiting' END AS status FROM r""",
    "v_ops",
)
def r11(spark, sf) -> DataFrame:
    """A stream of four stretches in an order of its own: gaps close later, up to the number that never comes; then what comes by a known number is in conflict."""
    rows = spark.sql(_ARRIVALS.replace("FROM v_ops", "FROM {v}"), v=view(spark, sf, "v_ops"))
    parts = live.committed_in_stretches(rows, "arrives")
    return parts["applied"].withColumn("status", F.lit("applied")).unionByName(parts["waiting"].withColumn("status", F.lit("waiting"))).unionByName(parts["quarantine"].withColumn("status", F.lit("quarantine"))).select("field_id", "op_id", "op_no", "status")


@query(
    "R07_heartbeat",
    """WITH e AS (SELECT DISTINCT field_id, epoch_us(ts) // 1000 AS ms FROM v_eav WHERE type LIKE 'Completed%'),
w AS (SELECT field_id, min(ms) AS ms FROM e GROUP BY field_id UNION ALL SELECT w.field_id, (SELECT min(e.ms) FROM e WHERE e.field_id = w.field_id AND e.ms >= w.ms + 3600000) FROM w WHERE w.ms IS NOT NULL)
SELECT field_id, ms FROM w WHERE ms IS NOT NULL""",
    "v_eav",
)
def r07(spark, sf) -> DataFrame:
    events = view(spark, sf, "v_eav").where("type LIKE 'Completed%'").select("field_id", F.unix_millis(c("ts").cast("timestamp")).alias("ms"))
    return ledger.heartbeats(events, 3_600_000)


@query("G28_calibration", "SELECT field_id, name, round(elevation_m + 0.5e0, 6) AS elevation_m, round(lat, 8) AS old_lat FROM v_benchmarks", "v_benchmarks")
def g28(spark, sf) -> DataFrame:
    from ..operators import gnss

    marks = view(spark, sf, "v_benchmarks")
    shift = marks.select("field_id").distinct().withColumn("de", F.lit(0.4)).withColumn("dn", F.lit(-0.2)).withColumn("dh", F.lit(0.5))
    moved = gnss.calibrated(marks.withColumn("height", c("elevation_m")), shift)
    back = gnss.calibrated(moved.withColumn("h0", c("height")), shift.select("field_id", (-c("de")).alias("de"), (-c("dn")).alias("dn"), (-c("dh")).alias("dh")))
    return back.select("field_id", "name", F.round("h0", 6).alias("elevation_m"), F.round("lat", 8).alias("old_lat"))
