"""Queries on streams: each runs a stream over the events to its end, or its batch twin where DuckDB is to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SURVEY_SPACING_M
from ..operators import gnss
from ..streaming import live
from .base import query, rounded, view
from .scalars import _MOVE

c = F.col


def _signals(events: DataFrame) -> DataFrame:
    return events.select(c("user_id").alias("machine_id"), "event_id", "ts", c("event_type").alias("type"), "value")


@query("R01_latest_signals", "SELECT user_id AS machine_id, event_type AS type, max_by(value, (epoch_us(ts), event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def r01(spark, sf) -> DataFrame:
    return live.drained(live.latest_signals(_signals(live.event_stream(spark, sf))), "update", ["machine_id", "type"])


_SESSIONS = """WITH g AS (SELECT user_id AS machine_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY machine_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT machine_id, k, count(*) AS n FROM s GROUP BY machine_id, k)
SELECT machine_id, count(*) AS n_sessions, max(n) AS longest FROM t GROUP BY machine_id"""


@query(
    "R05_link_sessions",
    _SESSIONS.split("t AS (")[0].rstrip().rstrip(",") + " SELECT machine_id, min(ts) AS heard_from, max(ts) + INTERVAL 6 HOUR AS lost_at, count(*) AS n FROM s GROUP BY machine_id, k",
)
def r05(spark, sf) -> DataFrame:
    """Streamed: a session's last form is the one that counts."""
    return live.drained(live.link_sessions(_signals(live.event_stream(spark, sf)), "6 hours"), "complete")


@query("R05_link_sessions_count", _SESSIONS)
def r05c(spark, sf) -> DataFrame:
    got = live.drained(live.link_sessions(_signals(live.event_stream(spark, sf)), "6 hours"), "complete")
    return got.groupBy("machine_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("R12_live_heights", "SELECT field_id, bx, by_, round(sum(delta_m), 6) AS moved_m, count(*) FILTER (delta_m < 0) AS n_cuts, count(*) FILTER (delta_m > 0) AS n_fills FROM v_op_bins GROUP BY field_id, bx, by_", "v_op_bins")
def r12(spark, sf) -> DataFrame:
    rows = live.event_stream(spark, sf, "lineitem").selectExpr("CAST(l_orderkey % 4 AS INT) AS field_id", "CAST(l_partkey % 50 AS INT) AS bx", "CAST(l_suppkey % 40 AS INT) AS by_", "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE -1 END * l_quantity / 1000.0e0 AS delta_m")
    return rounded(live.drained(live.live_heights(rows), "update", ["field_id", "bx", "by_"]), 6)


#: Fixes of three units of each machine, 400 ms apart: the tractor's always differ, the front pan's for four fixes in a row don't, the rear pan's only in its longitude.
_UNITS = """SELECT machine_id, unit, fast_ms, CASE unit WHEN 'tractor' THEN lat WHEN 'front' THEN 36.0e0 + floor(fast_ms / 1600.0e0) * 1e-6 ELSE 36.5e0 END AS lat,
CASE unit WHEN 'tractor' THEN lon WHEN 'front' THEN -93.0e0 ELSE -93.5e0 + floor(fast_ms / 6000.0e0) * 1e-6 END AS lon, speed_kph, heading_deg
FROM (SELECT machine_id, CAST(fast_ms * 2 / 5 AS BIGINT) AS fast_ms, lat, lon, speed_kph, heading_deg FROM v_fixes) CROSS JOIN (VALUES ('tractor'), ('front'), ('rear')) AS u(unit)"""
#: A chain: the first fix, then each time the first one at least a second later that differs from the last one logged.
_LOGGED = f"""WITH u AS ({_UNITS}), f AS (SELECT machine_id, unit, fast_ms, CASE unit WHEN 'tractor' THEN [lat, lon, speed_kph, heading_deg] ELSE [lat, lon] END AS a FROM u),
w AS (SELECT machine_id, unit, min(fast_ms) AS fast_ms, arg_min(a, fast_ms) AS a FROM f GROUP BY machine_id, unit
  UNION ALL SELECT w.machine_id, w.unit, min(f.fast_ms), arg_min(f.a, f.fast_ms) FROM w JOIN f ON f.machine_id = w.machine_id AND f.unit = w.unit AND f.fast_ms >= w.fast_ms + 1000 AND f.a <> w.a GROUP BY w.machine_id, w.unit)
SELECT machine_id, unit, fast_ms, unnest(CASE unit WHEN 'tractor' THEN ['TractorLatitude', 'TractorLongitude', 'Speedkph', 'Heading'] WHEN 'front' THEN ['FrontScraperLatitude', 'FrontScraperLongitude'] ELSE ['RearScraperLatitude', 'RearScraperLongitude'] END) AS type, round(unnest(a), 8) AS value FROM w"""


@query("R02_throttled_log", _LOGGED, "v_fixes")
def r02(spark, sf) -> DataFrame:
    fixes = spark.sql(_UNITS.replace("FROM v_fixes", "FROM {v}"), v=view(spark, sf, "v_fixes"))
    return rounded(live.replayed(fixes, "fast_ms", live.throttled_log), 8)


@query(
    "F14_throttle_changes",
    """WITH f AS (SELECT machine_id, event_id, CAST(fast_ms * 2 / 5 AS BIGINT) AS fast_ms, rtk FROM v_fixes),
w AS (SELECT machine_id, min(fast_ms) AS fast_ms, arg_min(rtk, fast_ms) AS rtk FROM f GROUP BY machine_id
  UNION ALL SELECT w.machine_id, min(f.fast_ms), arg_min(f.rtk, f.fast_ms) FROM w JOIN f ON f.machine_id = w.machine_id AND f.fast_ms >= w.fast_ms + 1000 AND f.rtk <> w.rtk GROUP BY w.machine_id)
SELECT f.machine_id, f.event_id, f.fast_ms, f.rtk FROM w JOIN f USING (machine_id, fast_ms)""",
    "v_fixes",
)
def f14(spark, sf) -> DataFrame:
    from ..operators import clean

    fixes = view(spark, sf, "v_fixes").select("machine_id", "event_id", (c("fast_ms") * 2 / 5).cast("long").alias("fast_ms"), "rtk")
    return clean.throttled(fixes, value="rtk")


#: Three fixed places a machine, so that there are stable spells; rtk without the rare None.
_STEADY = """SELECT machine_id, event_id, fast_ms, 36.0e0 + (machine_id % 3) * 1e-4 + (event_id % 5) * 1e-8 AS lat, -93.5e0 + (event_id % 7) * 1e-8 AS lon,
CASE WHEN fast_ms % 60000 < 50000 THEN 0.1e0 ELSE speed_kph END AS speed_kph, CASE WHEN fast_ms % 70000 = 0 THEN 'Float' WHEN event_id % 997 = 3 THEN 'None' ELSE 'Fix' END AS rtk, heading_deg FROM v_fixes"""


def _steady(spark, sf) -> DataFrame:
    return spark.sql(_STEADY.replace("FROM v_fixes", "FROM {v}"), v=view(spark, sf, "v_fixes"))


_QUALITY = f"""WITH f AS ({_STEADY}),
w AS (SELECT a.machine_id, a.fast_ms, avg(b.lat) AS lat0, avg(b.lon) AS lon0 FROM f a JOIN f b ON a.machine_id = b.machine_id AND b.fast_ms BETWEEN a.fast_ms - 60000 AND a.fast_ms AND b.rtk = 'Fix' GROUP BY a.machine_id, a.fast_ms),
e AS (SELECT *, 1 - 0.0066943799901413165e0 * pow(sin(radians(lat0)), 2) AS w FROM w),
j AS (SELECT e.machine_id, e.fast_ms, max(sqrt(pow(radians(b.lon - lon0) * 6378137.0e0 / sqrt(w) * cos(radians(lat0)) * 1000, 2) + pow(radians(b.lat - lat0) * 6378137.0e0 * (1 - 0.0066943799901413165e0) / (w * sqrt(w)) * 1000, 2))) AS mm
  FROM e JOIN f b ON e.machine_id = b.machine_id AND b.fast_ms BETWEEN e.fast_ms - 60000 AND e.fast_ms AND b.rtk = 'Fix' GROUP BY e.machine_id, e.fast_ms),
h AS (SELECT f.*, mm, rtk = 'Fix' AS a, rtk = 'Fix' AND speed_kph / 1.609344e0 < 0.2 AS b, rtk = 'Fix' AND coalesce(mm <= 25, false) AS d, fast_ms - lag(fast_ms) OVER (PARTITION BY f.machine_id ORDER BY f.fast_ms) > 2000 AS gap FROM f LEFT JOIN j USING (machine_id, fast_ms)),
i AS (SELECT *, sum(CASE WHEN NOT a OR coalesce(gap, false) THEN 1 ELSE 0 END) OVER o AS ia, sum(CASE WHEN NOT b OR coalesce(gap, false) THEN 1 ELSE 0 END) OVER o AS ib, sum(CASE WHEN NOT d OR coalesce(gap, false) THEN 1 ELSE 0 END) OVER o AS id FROM h WINDOW o AS (PARTITION BY machine_id ORDER BY fast_ms ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CASE WHEN a THEN fast_ms - min(CASE WHEN a THEN fast_ms END) OVER (PARTITION BY machine_id, ia) ELSE 0 END AS rtk_ms, CASE WHEN b THEN fast_ms - min(CASE WHEN b THEN fast_ms END) OVER (PARTITION BY machine_id, ib) ELSE 0 END AS parked_ms, CASE WHEN d THEN fast_ms - min(CASE WHEN d THEN fast_ms END) OVER (PARTITION BY machine_id, id) ELSE 0 END AS stable_ms FROM i),
q AS (SELECT *, CASE WHEN rtk = 'None' THEN 'NoFix' WHEN rtk <> 'Fix' THEN 'NoRtk' WHEN rtk_ms >= 45000 AND parked_ms >= 5000 AND stable_ms >= 15000 THEN 'HighQuality' WHEN stable_ms >= 15000 THEN 'Stable' ELSE 'Unstable' END AS state FROM t)
"""


@query("R03_quality_live", _QUALITY + "SELECT machine_id, event_id, fast_ms, state FROM q", "v_fixes")
def r03(spark, sf) -> DataFrame:
    return live.replayed(_steady(spark, sf), "fast_ms", live.quality_states)


@query("R03_quality_windows", _QUALITY + "SELECT machine_id, event_id, fast_ms, state FROM q", "v_fixes")
def r03w(spark, sf) -> DataFrame:
    return gnss.quality(_steady(spark, sf)).select("machine_id", "event_id", "fast_ms", "state")


@query("R04_quality_transitions", _QUALITY + ", l AS (SELECT machine_id, fast_ms, state AS new, lag(state) OVER (PARTITION BY machine_id ORDER BY fast_ms) AS old FROM q) SELECT * FROM l WHERE old <> new", "v_fixes")
def r04(spark, sf) -> DataFrame:
    return gnss.changes(gnss.quality(_steady(spark, sf)), "state").select("machine_id", "fast_ms", "new", "old")


#: Links that are lost for 8 s after 30 fixes each, and an antenna that changes after 45; each begins an epoch.
_BREAKS = f"""SELECT machine_id, event_id, fast_ms + 8000 * (fast_ms // 30000) AS fast_ms, lat, lon, speed_kph, rtk, CAST(fast_ms // 45000 AS VARCHAR) AS antenna FROM ({_STEADY})"""
_EPOCHS = f"""WITH b AS ({_BREAKS}), n AS (SELECT *, CASE WHEN fast_ms - lag(fast_ms) OVER w > 3000 OR antenna <> lag(antenna) OVER w THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY machine_id ORDER BY fast_ms)),
z AS (SELECT machine_id * 1000 + CAST(sum(new) OVER (PARTITION BY machine_id ORDER BY fast_ms) AS BIGINT) AS machine_id, event_id, fast_ms, lat, lon, speed_kph, rtk FROM n),
"""


@query("R04_reset_by_link_and_antenna", _QUALITY.replace(f"WITH f AS ({_STEADY}),", _EPOCHS + "f AS (SELECT * FROM z),") + "SELECT machine_id // 1000 AS machine_id, event_id, fast_ms, state FROM q", "v_fixes")
def r04r(spark, sf) -> DataFrame:
    rows = spark.sql(_BREAKS.replace("FROM v_fixes", "FROM {v}").replace("//", "DIV").replace("VARCHAR", "STRING"), v=view(spark, sf, "v_fixes"))
    return live.replayed(rows, "fast_ms", lambda fixes: live.quality_states(fixes, lost_ms=3000))


@query("F09_quality_gate", _QUALITY + "SELECT machine_id, event_id FROM q WHERE state IN ('Stable', 'HighQuality')", "v_fixes")
def f09(spark, sf) -> DataFrame:
    return gnss.quality(_steady(spark, sf)).where(c("state").isin("Stable", "HighQuality")).select("machine_id", "event_id")


@query("W04_dwell", _QUALITY + "SELECT machine_id, event_id, rtk_ms, parked_ms, stable_ms FROM t", "v_fixes")
def w04(spark, sf) -> DataFrame:
    return gnss.quality(_steady(spark, sf)).select("machine_id", "event_id", "rtk_ms", "parked_ms", "stable_ms")


@query("A17_jitter", _QUALITY + "SELECT machine_id, event_id, round(mm, 3) AS jitter_mm FROM h", "v_fixes")
def a17(spark, sf) -> DataFrame:
    return rounded(gnss.jitter(_steady(spark, sf)).select("machine_id", "event_id", "jitter_mm"), 3)


@query("W05_trailing_frame", "SELECT machine_id, event_id, CAST(count(*) FILTER (rtk = 'Fix') OVER (PARTITION BY machine_id ORDER BY fast_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS INT) AS n_frame FROM v_fixes", "v_fixes")
def w05(spark, sf) -> DataFrame:
    return gnss.jitter(view(spark, sf, "v_fixes")).select("machine_id", "event_id", "n_frame")


@query("A18_median_position", "SELECT machine_id, round(median(lat), 8) AS lat, round(median(lon), 8) AS lon, count(*) AS n FROM v_fixes WHERE rtk = 'Fix' GROUP BY machine_id", "v_fixes")
def a18(spark, sf) -> DataFrame:
    return rounded(gnss.median_position(view(spark, sf, "v_fixes")), 8)


@query("F08_valid_fixes", "WITH a AS (SELECT machine_id, event_id, CASE WHEN event_id % 50 = 0 THEN 0.0e0 ELSE lat END AS lat, CASE WHEN event_id % 50 = 0 THEN 0.5e0 ELSE lon END AS lon, (event_id % 5) * 700 AS age_ms FROM v_fixes) SELECT machine_id, event_id, age_ms <= 2000 AND NOT (abs(lat) <= 1 AND abs(lon) <= 1) AS valid FROM a", "v_fixes")
def f08(spark, sf) -> DataFrame:
    zero = c("event_id") % 50 == 0
    rows = view(spark, sf, "v_fixes").withColumn("lat", F.when(zero, 0.0).otherwise(c("lat"))).withColumn("lon", F.when(zero, 0.5).otherwise(c("lon"))).withColumn("age_ms", (c("event_id") % 5) * 700)
    return gnss.valid_fixes(rows).select("machine_id", "event_id", "valid")


@query(
    "J11_asof_vectors",
    "WITH v AS (SELECT machine_id, fast_ms + 300 AS fast_ms, heading_deg AS track, speed_kph AS kph FROM v_fixes WHERE event_id % 3 = 0) SELECT f.machine_id, f.event_id, v.track, round(v.kph, 9) AS kph FROM v_fixes f ASOF LEFT JOIN v ON f.machine_id = v.machine_id AND f.fast_ms >= v.fast_ms",
    "v_fixes",
)
def j11(spark, sf) -> DataFrame:
    fixes = view(spark, sf, "v_fixes").select("machine_id", "event_id", "fast_ms", "heading_deg", "speed_kph")
    vectors = fixes.where("event_id % 3 = 0").select("machine_id", (c("fast_ms") + 300).alias("fast_ms"), c("heading_deg").alias("track"), c("speed_kph").alias("kph"))
    return rounded(gnss.asof(fixes, vectors, ["track", "kph"]).select("machine_id", "event_id", "track", "kph"), 9)


@query("R09_dead_reckoning", _MOVE.replace("SELECT machine_id, event_id, radians(lon)", "SELECT machine_id, event_id, at_ms, radians(lon)").replace("FROM v_fixes)", "FROM g)").replace("WITH q AS", "WITH u AS (SELECT *, coalesce(lead(fast_ms) OVER (PARTITION BY machine_id ORDER BY fast_ms) - 1, fast_ms) AS until FROM v_fixes), g AS (SELECT *, unnest(range(fast_ms, until + 1, 250)) AS at_ms FROM u), q AS").replace("SELECT machine_id, event_id, round(degrees(p)", "SELECT machine_id, event_id, at_ms, round(degrees(p)").format(m="(speed_kph * (at_ms - fast_ms) / 3600.0e0)"), "v_fixes")
def r09(spark, sf) -> DataFrame:
    got = gnss.densified(view(spark, sf, "v_fixes"), 250)
    return got.select("machine_id", "event_id", "at_ms", F.round("at_lat", 8).alias("lat2"), F.round("at_lon", 8).alias("lon2"))


@query("W13_course", None)
def w13(spark, sf) -> DataFrame:
    return rounded(gnss.course(view(spark, sf, "v_fixes")).select("machine_id", "event_id", "moved_m", "course_deg", "gyro_offset_deg"))


@query("P27_tilt_corrected", None)
def p27(spark, sf) -> DataFrame:
    rows = view(spark, sf, "v_fixes").withColumn("roll_deg", (c("event_id") % 11 - 5).cast("double")).withColumn("pitch_deg", (c("event_id") % 7 - 3).cast("double"))
    rows = rows.withColumn("antenna_height_m", F.lit(3.2)).withColumn("antenna_right_m", F.lit(0.1)).withColumn("antenna_forward_m", F.lit(-0.4)).withColumn("altitude_m", F.lit(100.0))
    got = gnss.tilt_corrected(rows)
    return got.select("machine_id", "event_id", F.round("ground_lat", 8).alias("ground_lat"), F.round("ground_lon", 8).alias("ground_lon"), F.round("ground_m", 4).alias("ground_m"))


@query("W02_blade_edges", None)
def w02(spark, sf) -> DataFrame:
    rows = gnss.runs(view(spark, sf, "v_fixes").withColumn("mode", F.when(c("event_id") % 4 == 0, "FILL").otherwise("CUT")), "mode")
    got = gnss.blade_edges(rows, 3.0)
    return got.select("machine_id", "event_id", "run_id", *[F.round(x, 8).alias(x) for x in got.columns if x.endswith(("_lat", "_lon"))])


@query("W02_runs", "WITH m AS (SELECT machine_id, event_id, fast_ms, CASE WHEN event_id % 4 = 0 THEN 'FILL' ELSE 'CUT' END AS mode FROM v_fixes), n AS (SELECT *, CASE WHEN lag(mode) OVER w IS NULL OR lag(mode) OVER w <> mode THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY machine_id ORDER BY fast_ms)) SELECT machine_id, event_id, CAST(sum(new) OVER (PARTITION BY machine_id ORDER BY fast_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM n", "v_fixes")
def w02r(spark, sf) -> DataFrame:
    rows = view(spark, sf, "v_fixes").withColumn("mode", F.when(c("event_id") % 4 == 0, "FILL").otherwise("CUT"))
    return gnss.runs(rows, "mode").select("machine_id", "event_id", "run_id")


#: Blade passes: circles of 5 m, some by the left, five degrees a tick; two in three cut, some with the blade on the wrong side of the ground.
_TICKS = """SELECT CAST(machine_id % 3 AS INT) AS field_id, machine_id, CASE WHEN machine_id % 2 = 0 THEN 'front' ELSE 'rear' END AS pan, fast_ms AS ms, lane, turn,
lane * 9.0e0 + 8.0e0 + 5.0e0 * cos(radians(5.0e0 * turn * k)) AS x, 8.0e0 + 5.0e0 * sin(radians(5.0e0 * turn * k)) AS y, CASE WHEN turn > 0 THEN 360.0e0 - 5.0e0 * (k % 72) ELSE 180.0e0 + 5.0e0 * (k % 72) END AS heading_deg,
CASE WHEN lane % 3 = 2 THEN 'FILL' ELSE 'CUT' END AS mode, CASE WHEN k % 17 = 4 THEN 0.02e0 WHEN lane % 3 = 2 THEN 0.05e0 ELSE -0.03e0 END AS blade_m
FROM (SELECT machine_id, fast_ms, fast_ms / 1000 AS k, CAST(floor(fast_ms / 30000.0e0) AS INT) AS lane, CASE WHEN floor(fast_ms / 30000.0e0) % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS turn FROM v_fixes)"""


def ticks(spark, sf) -> DataFrame:
    return spark.sql(_TICKS.replace("FROM v_fixes", "FROM {v}"), v=view(spark, sf, "v_fixes")).drop("lane", "turn")


@query(
    "W03_swept_polygons",
    f"""WITH t AS ({_TICKS}), e AS (SELECT *, x - cos(radians(heading_deg)) * 1.5e0 AS lx, y + sin(radians(heading_deg)) * 1.5e0 AS ly, x + cos(radians(heading_deg)) * 1.5e0 AS rx, y - sin(radians(heading_deg)) * 1.5e0 AS ry FROM t),
p AS (SELECT *, lag(mode) OVER w AS m0, lag(lx) OVER w AS ax, lag(ly) OVER w AS ay, lag(rx) OVER w AS bx, lag(ry) OVER w AS by_ FROM e WINDOW w AS (PARTITION BY machine_id ORDER BY ms))
SELECT machine_id, ms, round(abs(ax * by_ - bx * ay + bx * ry - rx * by_ + rx * ly - lx * ry + lx * ay - ax * ly) / 2, 6) AS swept_m2 FROM p WHERE m0 = mode""",
    "v_fixes",
)
def w03(spark, sf) -> DataFrame:
    """Circles both ways; lane changes sweep across."""
    got = gnss.swept_polygons(ticks(spark, sf), 3.0, "ms").where("ring IS NOT NULL")
    return rounded(got.select("machine_id", "ms", "swept_m2"), 6)


@query("R06_blade_sweep", None)
def r06(spark, sf) -> DataFrame:
    """As a stream; every ninth bin of a field's corner has no data."""
    voids = spark.range(900).selectExpr("explode(array(0, 1, 2)) AS field_id", "CAST(id % 30 AS INT) AS bx", "CAST(id div 30 AS INT) AS by_").where("(bx * 7 + by_ * 3) % 9 = 0")
    return rounded(live.replayed(live.with_voids(ticks(spark, sf), voids), "ms", lambda rows: live.swept_ledger(rows, 3.0)), 6)


def _capture(spark, sf) -> DataFrame:
    """Fixes of survey drives: boundaries by the left and by the right, interiors, a spike now and then, some surveys without master benchmark."""
    states = gnss.quality(_steady(spark, sf))
    kind = F.when(c("event_id") % 2 == 0, "boundary").otherwise("interior")
    bump = F.when(c("event_id") % 29 == 0, -1.5).when(c("event_id") % 31 == 0, 1.2).otherwise(0.0)
    return states.select(
        c("machine_id").alias("survey_id"), kind.alias("kind"), F.when(c("machine_id") % 2 == 0, "left").otherwise("right").alias("side"), c("fast_ms").alias("seq"), (c("fast_ms") / 1000.0 * 2.5).alias("x"),
        F.lit(0.0).alias("y"), (100 + (c("event_id") % 10) * 0.01 + bump).alias("z"), "heading_deg", "state", F.when(c("machine_id") % 10 != 7, 95.0).alias("master_m"),
    )


@query("R08_survey_capture", None)
def r08(spark, sf) -> DataFrame:
    log = live.replayed(_capture(spark, sf), "seq", lambda rows: live.survey_capture(rows, SURVEY_SPACING_M))
    return rounded(live.standing_points(log), 6)
