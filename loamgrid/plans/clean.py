"""Queries on cleaning and on text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clean, grid
from ..sources import readers
from .base import query, rounded, view

c = F.col


def _window_sql(source: str, name: str) -> str:
    return f"""{name}a AS (SELECT field_id, avg(z) AS mean, stddev_pop(z) AS std, median(z) AS mid, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr FROM {source} GROUP BY field_id),
{name}m AS (SELECT s.field_id, median(abs(z - mid)) AS mad FROM {source} s JOIN {name}a USING (field_id) GROUP BY s.field_id),
{name} AS (SELECT field_id, mean, 3 * greatest(CASE WHEN mad <= 1e-12 THEN std ELSE 3 * 1.4826e0 * mad END, 1.5e0 * iqr, 1.0e0) AS half FROM {name}a JOIN {name}m USING (field_id))"""


@query(
    "F02_outliers",
    f"""WITH p AS (SELECT field_id, seq, existing + CASE WHEN seq % 401 = 0 THEN 40 ELSE 0 END AS z FROM v_points),
{_window_sql('p', 'w1')}, q AS (SELECT p.* FROM p JOIN w1 USING (field_id) WHERE abs(z - mean) <= half), {_window_sql('q', 'w2')}
SELECT p.field_id, seq, abs(z - mean) <= half AS accepted FROM p JOIN w2 USING (field_id)""",
    "v_points",
)
def f02(spark, sf) -> DataFrame:
    pts = view(spark, sf, "v_points").withColumn("existing", c("existing") + F.when(c("seq") % 401 == 0, 40).otherwise(0))
    return clean.without_outliers(pts).select("field_id", "seq", "accepted")


@query("F11_near_dots", None)
def f11(spark, sf) -> DataFrame:
    dots = grid.georeferenced(view(spark, sf, "v_haul")).select("field_id", "seq", c("e").alias("x"), c("n").alias("y"))
    return clean.without_near_dots(dots, 6.0).select("field_id", "seq")


@query("F11_near_pairs", None)
def f11p(spark, sf) -> DataFrame:
    """Kept dots still closer than the limit: there must be none."""
    dots = grid.georeferenced(view(spark, sf, "v_haul")).select("field_id", "seq", c("e").alias("x"), c("n").alias("y"))
    kept = clean.without_near_dots(dots, 6.0)
    b = kept.toDF(*[f"{k}2" for k in kept.columns])
    cell = lambda x: F.floor(c(x) / 6.0)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = kept.withColumn("s", F.explode(near)).withColumn("cx", cell("x") + c("s.i")).withColumn("cy", cell("y") + c("s.j"))
    b = b.withColumn("cx", cell("x2")).withColumn("cy", cell("y2"))
    met = a.join(b, ["cx", "cy"]).where((c("field_id") == c("field_id2")) & (c("seq") < c("seq2")) & (F.pow(c("x") - c("x2"), 2) + F.pow(c("y") - c("y2"), 2) < 36.0))
    return met.agg(F.count("*").alias("n_close"))


def _survey(spark, sf) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("machine_id").orderBy("fast_ms")).cast("long")
    rows = view(spark, sf, "v_fixes").select(c("machine_id").alias("survey_id"), F.lit("interior").alias("kind"), place.alias("seq"), "event_id")
    bump = F.when(c("event_id") % 17 == 0, -1.5).when(c("event_id") % 23 == 0, 1.2).otherwise(0.0)
    return rows.select("survey_id", "kind", "seq", (c("seq") * 2.0).alias("x"), F.lit(0.0).alias("y"), (30 + (c("event_id") % 5) * 0.01 + bump).alias("z"))


@query("F12_spikes", None)
def f12(spark, sf) -> DataFrame:
    return rounded(clean.without_spikes(_survey(spark, sf)))


@query("F13_spacing", "WITH r AS (SELECT user_id AS survey_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT survey_id, seq FROM r WHERE (seq - 1) % 2 = 0")
def f13(spark, sf) -> DataFrame:
    return clean.spaced(_survey(spark, sf)).select("survey_id", "seq")


def _text(x, digits: int = 8):
    return x.cast(f"decimal(20,{digits})").cast("string")


@query(
    "S01_points_strict",
    "SELECT field_id, seq, CASE WHEN seq % 19 = 0 THEN 'benchmark' ELSE 'point' END AS kind, round(CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 7 = 0 THEN 0 ELSE existing END - target ELSE -0.25e0 END, 9) AS cutfill_m FROM (SELECT field_id, seq, CAST(CAST(existing AS DECIMAL(20, 8)) AS DOUBLE) AS existing, CAST(CAST(target AS DECIMAL(20, 8)) AS DOUBLE) AS target FROM v_points) p WHERE seq % 19 = 0 OR seq % 7 <> 0",
    "v_points",
)
def s01(spark, sf) -> DataFrame:
    p = view(spark, sf, "v_points")
    blank = F.when(c("seq") % 3 == 0, "0.000").otherwise("0.25")
    height = F.when(c("seq") % 7 == 0, "0").otherwise(_text(c("existing")))
    line = F.concat_ws(",", _text(c("lat")), _text(c("lon")), height, _text(c("target")), blank, F.when(c("seq") % 19 == 0, "BM1").otherwise("3GRD"), F.concat(c("field_id").cast("string"), F.lit(":"), c("seq").cast("string")))
    got = readers.points_strict(p.select(F.lit("f.agd").alias("file"), c("seq"), line.alias("line")))
    key = F.split("comment", ":")
    got = got.select(key[0].cast("int").alias("field_id"), key[1].cast("long").alias("seq"), "kind", "cutfill_m")
    return rounded(got, 9)


@query("S01b_points_lenient", "SELECT seq, CASE WHEN seq % 19 = 0 THEN 'benchmark' ELSE 'point' END AS kind, CAST(CAST(existing AS DECIMAL(20, 8)) AS DOUBLE) AS existing FROM v_points WHERE seq % 7 <> 0", "v_points")
def s01b(spark, sf) -> DataFrame:
    height = F.when(c("seq") % 7 == 0, "n/a").otherwise(_text(c("existing")))
    line = F.concat_ws(",", _text(c("lat")), _text(c("lon")), height, _text(c("target")), F.when(c("seq") % 19 == 0, "mb").otherwise("p"))
    return readers.points_lenient(view(spark, sf, "v_points").select(F.lit("f.agd").alias("file"), "seq", line.alias("line"))).select("seq", "kind", "existing")


_KIND = "CASE WHEN seq % 100 = 0 THEN 'master' WHEN seq % 31 = 0 THEN 'benchmark' WHEN seq % 5 = 0 THEN 'boundary' ELSE 'interior' END"


def _survey_text(spark, sf) -> DataFrame:
    code = F.when(c("seq") % 100 == 0, "MB").when(c("seq") % 31 == 0, "BM2").when(c("seq") % 5 == 0, "2PER").otherwise("3GRD")
    line = F.concat_ws(",", F.when(c("seq") % 41 == 0, "bad").otherwise(_text(c("lat"))), _text(c("lon")), _text(c("existing")), code)
    return view(spark, sf, "v_points").select(c("field_id").cast("string").alias("file"), "seq", line.alias("line"))


@query("S02_survey_scan", f"SELECT CAST(field_id AS VARCHAR) AS file, seq, {_KIND} AS kind FROM v_points WHERE seq % 41 <> 0", "v_points")
def s02(spark, sf) -> DataFrame:
    return readers.survey(_survey_text(spark, sf))[0].select("file", "seq", "kind")


@query("S02_survey_rejects", "SELECT CAST(field_id AS VARCHAR) AS file, seq FROM v_points WHERE seq % 41 = 0", "v_points")
def s02r(spark, sf) -> DataFrame:
    return readers.survey(_survey_text(spark, sf))[1].select("file", "seq")


@query(
    "S04_survey_lines",
    f"WITH k AS (SELECT field_id, seq, {_KIND} AS kind FROM v_points WHERE seq % 41 <> 0) SELECT CAST(field_id AS VARCHAR) AS file, seq, row_number() OVER (PARTITION BY field_id ORDER BY CASE kind WHEN 'master' THEN 0 WHEN 'benchmark' THEN 1 WHEN 'boundary' THEN 2 ELSE 3 END, seq) AS line_no FROM k",
    "v_points",
)
def s04(spark, sf) -> DataFrame:
    rows = readers.survey(_survey_text(spark, sf))[0]
    lines = readers.survey_lines(rows)
    again = readers.survey(lines.select("file", c("line_no").alias("seq"), "line"))[0]
    back = again.select("file", c("seq").alias("line_no"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "kind")
    first = rows.select("file", "seq", "kind", F.row_number().over(Window.partitionBy("file").orderBy(F.when(c("kind") == "master", 0).when(c("kind") == "benchmark", 1).when(c("kind") == "boundary", 2).otherwise(3), "seq")).alias("line_no"))
    return first.join(back, ["file", "line_no", "kind"]).select("file", "seq", "line_no")


@query("S03_multiplane", "SELECT seq, round(seq * 1.0e0, 3) AS de, round(seq * -2.0e0, 3) AS dn FROM (SELECT unnest(range(1, (SELECT count(*) FROM supplier))) AS seq)")
def s03(spark, sf) -> DataFrame:
    from ..functions import geo

    n = view(spark, sf, "v_benchmarks").withColumn("seq", F.expr("CAST(regexp_extract(name, '(\\\\d+)$', 1) AS BIGINT)"))
    head = F.lit("1\t0\t0\t100\tMB 36 0 0.0 N / 93 0 0.0 W")
    body = F.concat_ws("\t", c("seq").cast("string"), c("seq").cast("string"), (c("seq") * -2).cast("string"), F.lit("30.5"), F.lit("B"))
    got = readers.multiplane(n.select(F.lit("survey_m.txt").alias("file"), "seq", F.when(c("seq") == 0, head).otherwise(body).alias("line")))
    e0, m0 = geo.to_utm(F.lit(36.0), F.lit(-93.0))
    return rounded(grid.georeferenced(got).select("seq", (c("e") - e0).alias("de"), (c("n") - m0).alias("dn")), 3)


@query("S05_haul_samples", "SELECT seq, direction_deg FROM v_haul WHERE seq % 9 <> 0", "v_haul")
def s05(spark, sf) -> DataFrame:
    line = F.concat_ws(",", _text(c("lat")), _text(c("lon")), F.when(c("seq") % 9 == 0, "north").otherwise(c("direction_deg").cast("string")), F.lit("image"))
    return readers.haul_samples(view(spark, sf, "v_haul").select(F.lit("h.csv").alias("file"), "seq", line.alias("line"))).select("seq", "direction_deg")


def _log(spark, sf) -> DataFrame:
    f = view(spark, sf, "v_fixes")
    degrees = lambda x, w: F.concat(F.lpad(F.floor(F.abs(x)).cast("string"), w, "0"), F.lpad(((F.abs(x) - F.floor(F.abs(x))) * 60).cast("decimal(12,7)").cast("string"), 10, "0"))
    quality = F.when(c("rtk") == "Fix", "4").when(c("rtk") == "Float", "5").otherwise("0")
    gga = F.concat_ws(",", F.when(c("event_id") % 2 == 0, "$GNGGA").otherwise("$GPGGA"), F.lit("010203.50"), degrees(c("lat"), 2), F.lit("N"), degrees(c("lon"), 3), F.lit("W"), quality, F.lit("12"), F.lit("0.8"), F.lit("101.5"), F.lit("M"), F.lit(""), F.lit("M"), F.lit(""), F.lit("*55"))
    vtg = F.concat_ws(",", F.lit("$GNVTG"), c("heading_deg").cast("string"), F.lit("T,,M"), F.lit("0"), F.lit("N"), c("speed_kph").cast("decimal(10,4)").cast("string"), F.lit("K*11"))
    line = F.when(c("event_id") % 10 == 7, "$GNRMC,x*00").when(c("event_id") % 10 < 6, gga).otherwise(vtg)
    return f.select("machine_id", c("fast_ms").alias("seq"), line.alias("line"))


@query("S14_receiver_fixes", "SELECT machine_id, fast_ms AS seq, CAST(round(lat * 4000000) AS BIGINT) AS lat, CAST(round(lon * 4000000) AS BIGINT) AS lon, rtk, 101.5e0 AS altitude_m, 3723500 AS day_ms FROM v_fixes WHERE event_id % 10 < 6", "v_fixes")
def s14(spark, sf) -> DataFrame:
    whole = lambda x: F.round(c(x) * 4000000).cast("long").alias(x)
    return readers.receiver_log(_log(spark, sf))[0].select("machine_id", "seq", whole("lat"), whole("lon"), "rtk", "altitude_m", "day_ms")


@query("S14_receiver_vectors", "SELECT machine_id, fast_ms AS seq, heading_deg AS track_deg, CAST(CAST(speed_kph AS DECIMAL(10, 4)) AS DOUBLE) AS speed_kph FROM v_fixes WHERE event_id % 10 IN (6, 8, 9)", "v_fixes")
def s14v(spark, sf) -> DataFrame:
    return readers.receiver_log(_log(spark, sf))[1]


@query("S14_receiver_rejects", "SELECT machine_id, fast_ms AS seq FROM v_fixes WHERE event_id % 10 = 7", "v_fixes")
def s14r(spark, sf) -> DataFrame:
    return readers.receiver_log(_log(spark, sf))[2].select("machine_id", "seq")


@query("S15_footprints", "SELECT 'field' || seq AS stem, round(lat - 0.5, 8) AS south, round(lat + 0.25, 8) AS north, round(lon - 0.125, 8) AS west, round(lon + 1, 8) AS east FROM (SELECT seq, CAST(CAST(lat AS DECIMAL(20, 8)) AS DOUBLE) AS lat, CAST(CAST(lon AS DECIMAL(20, 8)) AS DOUBLE) AS lon FROM v_haul) h", "v_haul")
def s15(spark, sf) -> DataFrame:
    h = view(spark, sf, "v_haul").withColumn("lat", c("lat").cast("decimal(20,8)")).withColumn("lon", c("lon").cast("decimal(20,8)"))
    spot = lambda dx, dy: F.concat((c("lon") + F.lit(dx).cast("decimal(9,3)")).cast("string"), F.lit(","), (c("lat") + F.lit(dy).cast("decimal(9,3)")).cast("string"), F.lit(",0"))
    text = F.concat(F.lit("<kml><coordinates>\n "), F.concat_ws(" ", spot(-0.125, -0.5), spot(1.0, 0.0), spot(0.0, 0.25)), F.lit(" </coordinates></kml>"))
    files = h.select(F.concat(F.lit("field"), c("seq").cast("string"), F.lit(".kml")).alias("file"), text.alias("text"))
    images = h.select(F.concat(F.lit("field"), c("seq").cast("string"), F.lit(".png")).alias("file"))
    return readers.footprints(files, images).select("stem", *[F.round(x, 8).alias(x) for x in ("south", "north", "west", "east")])
