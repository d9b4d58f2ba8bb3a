"""The register of queries, and the engine's tables as projections of the given ones, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BIN_M
from ..functions import geo
from ..operators import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed projections that run on either engine.
VIEWS = {
    "v_points": """SELECT CAST(l_orderkey % 4 AS INT) AS field_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq,
  36.0e0 + ((l_partkey * 37 + l_orderkey * 11) % 4001) * 2.5e-7 AS lat, -93.5e0 + ((l_suppkey * 53 + l_orderkey * 17 + l_linenumber * 101) % 3001) * 2.5e-7 AS lon,
  30.0e0 + ((l_partkey * 37 + l_orderkey * 11) % 4001) * 1.25e-4 + l_quantity / 500.0e0 AS existing,
  30.3e0 + ((l_suppkey * 53 + l_orderkey * 17 + l_linenumber * 101) % 3001) * 1.0e-4 AS target FROM lineitem""",
    "v_grid": """SELECT 0 AS field_id, CAST(p_partkey % 50 AS INT) AS bx, CAST(floor(p_partkey / 50.0e0) AS INT) AS by_,
  30.0e0 + ((p_partkey * 7919) % 997) / 997.0e0 + (p_partkey % 50) * 0.02e0 AS z FROM part""",
    "v_fixes": """SELECT user_id AS machine_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 1000 AS fast_ms,
  36.0e0 + ((event_id * 13) % 4001) * 2.5e-7 AS lat, -93.5e0 + ((event_id * 29) % 3001) * 2.5e-7 AS lon,
  value - 15.0e0 * floor(value / 15.0e0) AS speed_kph, CAST((event_id * 37) % 360 AS DOUBLE) AS heading_deg,
  CASE event_type WHEN 'error' THEN 'None' WHEN 'view' THEN 'Float' ELSE 'Fix' END AS rtk FROM events""",
    "v_eav": """SELECT CAST(user_id % 4 AS INT) AS field_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'CompletedCutCY' WHEN 'signup' THEN 'CompletedFillCY'
  WHEN 'click' THEN 'Speedkph' WHEN 'view' THEN 'Heading' ELSE 'FrontBladeHeight' END AS type, value FROM events""",
    "v_ops": """SELECT CAST(o_orderkey % 4 AS INT) AS field_id, o_orderkey AS op_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FILL' ELSE 'CUT' END AS op_type, o_orderdate AS started_at FROM orders""",
    "v_op_bins": """SELECT CAST(l_orderkey % 4 AS INT) AS field_id, l_orderkey AS op_id, CAST(l_partkey % 50 AS INT) AS bx, CAST(l_suppkey % 40 AS INT) AS by_,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE -1 END * l_quantity / 1000.0e0 AS delta_m FROM lineitem""",
    "v_benchmarks": """SELECT CAST(s_suppkey % 4 AS INT) AS field_id, s_name AS name, 36.0e0 + ((s_suppkey * 211) % 4001) * 2.5e-7 AS lat,
  -93.5e0 + ((s_suppkey * 157) % 3001) * 2.5e-7 AS lon, 30.0e0 + s_acctbal / 10000.0e0 AS elevation_m FROM supplier""",
    "v_haul": """SELECT CAST(c_custkey % 4 AS INT) AS field_id, c_custkey AS seq, 36.0e0 + ((c_custkey * 97) % 4001) * 2.5e-7 AS lat,
  -93.5e0 + ((c_custkey * 61) % 3001) * 2.5e-7 AS lon, CAST((c_custkey * 29) % 360 AS DOUBLE) AS direction_deg FROM customer""",
}
_TABLE = {"v_points": "lineitem", "v_grid": "part", "v_fixes": "events", "v_eav": "events", "v_ops": "orders", "v_op_bins": "lineitem", "v_benchmarks": "supplier", "v_haul": "customer"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _TABLE[name]
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def query(name: str, sql: str | None = None, needs: str = "") -> Callable:
    """Register a function of (spark, sf_dir); sql gets the views and common tables that it needs as WITH."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, needs)
        return f

    return put


def utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing of zone 15 (all given tables lie there, north of the equator) in SQL."""
    e2, ep2, p = repr(geo.E2) + "e0", repr(geo.EP2) + "e0", f"radians({lat})"
    n = f"(6378137.0e0 / sqrt(1 - {e2} * sin({p}) * sin({p})))"
    t, c, a = f"(tan({p}) * tan({p}))", f"({ep2} * cos({p}) * cos({p}))", f"(cos({p}) * radians({lon} + 93.0e0))"
    k = [1 - geo.E2 / 4 - 3 * geo.E2**2 / 64 - 5 * geo.E2**3 / 256, 3 * geo.E2 / 8 + 3 * geo.E2**2 / 32 + 45 * geo.E2**3 / 1024, 15 * geo.E2**2 / 256 + 45 * geo.E2**3 / 1024, 35 * geo.E2**3 / 3072]
    m = f"(6378137.0e0 * ({k[0]:.17e} * {p} - {k[1]:.17e} * sin(2 * {p}) + {k[2]:.17e} * sin(4 * {p}) - {k[3]:.17e} * sin(6 * {p})))"
    east = f"(500000.0e0 + 0.9996e0 * {n} * {a} * (1 + (1 - {t} + {c}) * {a} * {a} / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {ep2}) * pow({a}, 4) / 120))"
    north = f"(0.9996e0 * ({m} + {n} * tan({p}) * {a} * {a} * (0.5e0 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * {a} * {a} / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {ep2}) * pow({a}, 4) / 720)))"
    return east, north


_E, _N = utm_sql("lat", "lon")
#: Tables that many queries share, with the views that they need.
COMMON = {
    "utm": (f"SELECT *, {_E} AS e, {_N} AS n FROM v_points", ("v_points",)),
    "extents": (
        f"SELECT field_id, min(e) AS min_e, min(n) AS min_n, max(e) AS max_e, max(n) AS max_n, CAST(ceil((max(e) - min(e)) / {BIN_M}e0) AS INT) AS width, CAST(ceil((max(n) - min(n)) / {BIN_M}e0) AS INT) AS height FROM utm GROUP BY field_id",
        ("utm",),
    ),
    "binned": (f"SELECT u.*, CAST(floor((e - min_e) / {BIN_M}e0) AS INT) AS bx, CAST(floor((n - min_n) / {BIN_M}e0) AS INT) AS by_, width, height FROM utm u JOIN extents USING (field_id)", ("extents",)),
    "bins": ("SELECT field_id, bx, by_, avg(existing) AS existing, avg(target) AS target, count(*) AS n_points FROM binned WHERE bx < width AND by_ < height GROUP BY field_id, bx, by_", ("binned",)),
}


def with_views(sql: str, needs: str) -> str:
    """sql behind WITH of the named views and common tables and what those need in turn."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in COMMON:
            text, more = COMMON[name]
            for m in more:
                add(m)
            parts[name] = text
        elif name in VIEWS:
            parts[name] = VIEWS[name]

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{k} AS ({v})" for k, v in parts.items())
    if not head:
        return sql
    return f"WITH RECURSIVE {head},\n{sql[5:]}" if sql.startswith("WITH ") else f"WITH {head}\n{sql}"


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bin_means(grid.binned(grid.georeferenced(view(spark, sf_dir, "v_points"))))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits: sums differ in the last ones between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
