"""Haul headings and paths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BIN_M
from ..functions import geo
from . import grid, nearest, tables
from .loops import cut

c = F.col
KEY = grid.KEY
#: Headings look this many bins ahead and aside, and a bin counts as on the ray within this share of a bin (3 inches of 24).
AHEAD, ASIDE, NEAR, MAX_TURN, MAX_STEPS = 8, 4, 3 / 24, 90.0, 10_000
TURN_CIRCLE_M = 2.0


def bin_vectors(samples: DataFrame) -> DataFrame:
    """Unit mean vector of each bin's headings (direction_deg); bins whose headings cancel drop out."""
    x, y = geo.heading_vector(c("direction_deg"))
    got = samples.groupBy(*KEY).agg(F.sum(x).alias("x"), F.sum(y).alias("y")).withColumn("l", F.sqrt(c("x") * c("x") + c("y") * c("y")))
    return got.where("l > 1e-9").select(*KEY, (c("x") / c("l")).alias("vx"), (c("y") / c("l")).alias("vy"))


def circular_mean(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean heading of each group; the last one where headings cancel."""
    x, y = geo.heading_vector(c("direction_deg"))
    got = samples.groupBy(*keys).agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.max_by("direction_deg", order).alias("last"))
    return got.select(*keys, F.when(F.sqrt(c("x") * c("x") + c("y") * c("y")) > 1e-9, geo.vector_heading(c("x"), c("y"))).otherwise(geo.normal(c("last"))).alias("mean_deg"))


def spread_headings(bins: DataFrame, known: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Vectors for bins (field_id, bx, by_) from known ones (vx, vy): in each round, bins with at least two known 8-neighbours get their normalised sum; only the frontier is joined. What no round reaches gets the nearest known vector."""
    have = cut(known.select(*KEY, "vx", "vy"))
    front, pending = have, cut(bins.select(*KEY).join(have, KEY, "left_anti"))
    sums = None
    for _ in range(max_rounds):
        sent = grid.neighbours(front, True, "vx", "vy").join(pending, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("vx").alias("vx"), F.sum("vy").alias("vy"))
        sums = sent if sums is None else sums.join(pending, KEY, "left_semi").unionByName(sent).groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("vx").alias("vx"), F.sum("vy").alias("vy"))
        sums = cut(sums)
        size = F.sqrt(c("vx") * c("vx") + c("vy") * c("vy"))
        front = cut(sums.where((c("n") >= 2) & (size > 1e-9)).select(*KEY, (c("vx") / size).alias("vx"), (c("vy") / size).alias("vy")))
        if front.isEmpty():
            break
        have = cut(have.unionByName(front))
        pending = cut(pending.join(front, KEY, "left_anti"))
    else:
        raise RuntimeError("the headings did not settle")
    return have.unionByName(nearest_vectors(pending, have))


def nearest_vectors(bins: DataFrame, known: DataFrame) -> DataFrame:
    """The vector of the nearest known bin (squared distance, then by_, bx) of each bin; null in fields without any."""
    place = lambda df: df.withColumn("x", c("bx").cast("double")).withColumn("y", c("by_").cast("double"))
    order = c("by_").cast("long") * (1 << 32) + c("bx")
    near = nearest.nearest_points(place(bins.select(*KEY)), place(known.withColumn("seq", order)).select("field_id", "seq", "x", "y", "vx", "vy"), 1)
    return bins.select(*KEY).join(near.select(*KEY, "vx", "vy"), KEY, "left")


def blended(vectors: DataFrame, sampled: DataFrame, passes: int = 5) -> DataFrame:
    """Headings smoothed with their neighbours: own weight 6 and 0.35 for each neighbour at sampled bins, 1 and 0.8 elsewhere; a pass reads the pass before only."""
    now = vectors.join(sampled.select(*KEY).distinct().withColumn("hit", F.lit(True)), KEY, "left").select(*KEY, "vx", "vy", F.coalesce("hit", F.lit(False)).alias("hit"))
    for _ in range(passes):
        sent = grid.neighbours(now, True, "vx", "vy").groupBy(*KEY).agg(F.sum("vx").alias("sx"), F.sum("vy").alias("sy"))
        own, other = F.when(c("hit"), 6.0).otherwise(1.0), F.when(c("hit"), 0.35).otherwise(0.8)
        got = now.join(sent, KEY, "left").fillna({"sx": 0.0, "sy": 0.0}).withColumn("x", own * c("vx") + other * c("sx")).withColumn("y", own * c("vy") + other * c("sy"))
        size = F.sqrt(c("x") * c("x") + c("y") * c("y"))
        now = cut(got.select(*KEY, F.when(size > 1e-9, c("x") / size).otherwise(c("vx")).alias("vx"), F.when(size > 1e-9, c("y") / size).otherwise(c("vy")).alias("vy"), "hit"))
    return now.drop("hit")


def look_ahead(headings: DataFrame, keys: list[str], order: str, window: int = 6) -> DataFrame:
    """headings (heading_deg) with ahead_deg, the circular mean of the row and those that follow, where there are at least two; the last one where they cancel."""
    x, y = geo.heading_vector(c("heading_deg"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, window - 1)
    got = headings.withColumn("__x", F.sum(x).over(w)).withColumn("__y", F.sum(y).over(w)).withColumn("__last", F.last("heading_deg").over(w)).withColumn("__n", F.count("*").over(w))
    mean = F.when(F.sqrt(c("__x") * c("__x") + c("__y") * c("__y")) > 1e-9, geo.vector_heading(c("__x"), c("__y"))).otherwise(geo.normal(c("__last")))
    return got.withColumn("ahead_deg", F.when(c("__n") >= 2, mean)).drop("__x", "__y", "__last", "__n")


def successors(headings: DataFrame) -> DataFrame:
    """(field_id, bx, by_, nx, ny): the next bin on each bin's heading (heading_deg), or none.

    A bin is on the heading if the ray from the centre comes within 3 inches of its own centre; the first whose circle of
    that radius the ray enters wins. Looked at are the bins up to 8 ahead and 4 aside; only where there is none of those
    at all, those within 10 either way. Turns of over 90 degrees end a path. Offsets that the ray misses never meet the
    table, so a bin is joined to one or two others.
    """
    vx, vy = geo.heading_vector(c("heading_deg"))
    h = headings.select(*KEY, "heading_deg", vx.alias("vx"), vy.alias("vy"))
    there = headings.select("field_id", c("bx").alias("nx"), c("by_").alias("ny"), c("heading_deg").alias("next_deg"))
    reach = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    # The place ahead and aside is rounded as a place in the grid, where halves go to the even bin.
    around = lambda rows: (
        rows.withColumn("k", reach(1, AHEAD)).withColumn("j", reach(-ASIDE, ASIDE))
        .withColumn("nx", F.rint(c("bx") + 0.5 + c("k") * c("vx") - c("j") * c("vy") - 0.5).cast("int")).withColumn("ny", F.rint(c("by_") + 0.5 + c("k") * c("vy") + c("j") * c("vx") - 0.5).cast("int"))
        .where((c("nx") != c("bx")) | (c("ny") != c("by_")))
    )

    def first_hit(rows: DataFrame) -> DataFrame:
        dx, dy = c("nx") - c("bx"), c("ny") - c("by_")
        along = dx * c("vx") + dy * c("vy")
        aside2 = F.greatest(dx * dx + dy * dy - along * along, F.lit(0.0))
        half = F.sqrt(NEAR * NEAR - aside2)
        on = rows.where((along > 1e-9) & (aside2 <= NEAR * NEAR)).withColumn("enter", F.when(along - half > 1e-9, along - half).otherwise(along + half))
        met = on.join(there, ["field_id", "nx", "ny"])
        return met.groupBy(*KEY, "heading_deg").agg(F.min_by(F.struct("nx", "ny", "next_deg"), F.struct("enter", "ny", "nx")).alias("n"))

    ahead = first_hit(around(h))
    missed = h.join(ahead, KEY, "left_anti")
    blocked = around(missed).join(there, ["field_id", "nx", "ny"], "left_semi").select(*KEY).distinct()
    square = missed.join(blocked, KEY, "left_anti").withColumn("k", reach(-10, 10)).withColumn("j", reach(-10, 10)).withColumn("nx", c("bx") + c("k")).withColumn("ny", c("by_") + c("j"))
    got = ahead.unionByName(first_hit(square.where((c("nx") != c("bx")) | (c("ny") != c("by_")))))
    return got.where(geo.turn(c("heading_deg"), c("n.next_deg")) <= MAX_TURN).select(*KEY, c("n.nx").alias("nx"), c("n.ny").alias("ny"))


def routes(starts: DataFrame, next_bins: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """starts (field_id, path_id, bx, by_) with route, the array of bins from the start on.

    A route ends before its first repeat, where there is no next bin, or after max_steps. Routes double: after k rounds a
    row a step is known up to 2^k steps, and each bin's goal 2^k steps on, so rows are at most twice the steps of the
    routes. Only routes that neither ended nor met themselves go on.
    """
    jump = cut(next_bins.select(*KEY, "nx", "ny"))
    going = cut(starts.select("field_id", "path_id", F.lit(0).alias("pos"), "bx", "by_"))
    ended, known = [], 1
    path = Window.partitionBy("field_id", "path_id")
    same_bin = Window.partitionBy("field_id", "path_id", "bx", "by_").orderBy("pos")
    while True:
        on = going.join(jump, KEY).select("field_id", "path_id", (c("pos") + known).alias("pos"), c("nx").alias("bx"), c("ny").alias("by_"))
        known *= 2
        steps = going.unionByName(on).withColumn("again", F.row_number().over(same_bin) > 1)
        steps = steps.withColumn("stop", F.min(F.when(c("again"), c("pos"))).over(path)).withColumn("n", F.count("*").over(path))
        steps = cut(steps.withColumn("over", c("stop").isNotNull() | (c("n") < known) | F.lit(known > max_steps)))
        ended.append(steps.where(c("over") & (c("pos") < F.coalesce("stop", F.lit(max_steps + 1))) & (c("pos") <= max_steps)).select("field_id", "path_id", "pos", "bx", "by_"))
        going = steps.where("NOT over").select("field_id", "path_id", "pos", "bx", "by_")
        if known > max_steps or going.isEmpty():
            break
        far = jump.toDF("field_id", "nx", "ny", "fx", "fy")
        jump = cut(jump.join(far, ["field_id", "nx", "ny"]).select(*KEY, c("fx").alias("nx"), c("fy").alias("ny")))
    rows = reduce(DataFrame.unionByName, ended).groupBy("field_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("pos", c("bx").alias("x"), c("by_").alias("y")))).alias("r"))
    return rows.select("field_id", "path_id", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("route"))


def _turned(start: float, wanted: np.ndarray, limit: float) -> np.ndarray:
    """Headings from start on that follow the wanted ones by at most limit degrees a step."""
    out = [start]
    for w in wanted[1:]:
        out.append(out[-1] + max(-limit, min(limit, (w - out[-1] + 180) % 360 - 180)))
    return np.array(out)


def _mean_heading(deg: np.ndarray) -> float:
    """Circular mean; the last one where they cancel."""
    x, y = np.sin(np.radians(deg)).sum(), np.cos(np.radians(deg)).sum()
    return float(deg[-1]) if max(abs(x), abs(y)) < 1e-12 else float(np.degrees(np.arctan2(x, y)))


def _smooth(p: np.ndarray, heading: np.ndarray, turn_circle: float, window: int = 6, pad: float = 0.22, samples: int = 6) -> np.ndarray:
    """One route of bin centres, in bins, as a smooth line.

    The heading wanted at a bin is the mean of the window ahead, then low-passed along the route; the one taken follows it
    within the turning circle. Two passes draw each taken heading to the mean of itself and its neighbours, and limit the
    turns anew. Bins are joined by Hermite curves whose tangents shrink with the turn, held to the bins' box and a margin.
    """
    n = len(p)
    if n < 2:
        return p
    swing = lambda a, b: (b - a + 180) % 360 - 180
    limit = math.degrees(BIN_M / max(0.01, turn_circle / 2))
    wanted = np.array([_mean_heading(heading[i : i + window]) for i in range(n)])
    for i in range(1, n):
        wanted[i] = wanted[i - 1] + 0.30 * swing(wanted[i - 1], wanted[i])
    taken = _turned(float(heading[0]), wanted, limit)
    for _ in range(2):
        drawn = taken.copy()
        for i in range(1, n - 1):
            drawn[i] = taken[i] + 0.35 * swing(taken[i], _mean_heading(taken[i - 1 : i + 2]))
        taken = _turned(drawn[0], drawn, limit)
    s = (np.arange(samples) / samples)[:, None]
    way = np.stack([np.sin(np.radians(taken)), np.cos(np.radians(taken))], axis=1)
    out = []
    for i in range(n - 1):
        a, b = p[i], p[i + 1]
        sharp = min(1.0, abs(swing(taken[i], taken[i + 1])) / 180)
        pull = np.linalg.norm(b - a) * (0.45 + (0.12 - 0.45) * sharp)
        curve = (2 * s**3 - 3 * s**2 + 1) * a + (s**3 - 2 * s**2 + s) * pull * way[i] + (3 * s**2 - 2 * s**3) * b + (s**3 - s**2) * pull * way[i + 1]
        out.append(np.clip(curve, np.minimum(a, b) - pad, np.maximum(a, b) + pad))
    return np.concatenate([*out, p[-1:]])


def _simple(p: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    """A line without points in line with the last one kept and the next."""
    keep = [0]
    for i in range(1, len(p) - 1):
        a, b = p[i] - p[keep[-1]], p[i + 1] - p[i]
        if abs(a[0] * b[1] - a[1] * b[0]) >= eps:
            keep.append(i)
    return p[[*keep, len(p) - 1]] if len(p) > 1 else p


def smooth_paths(steps: DataFrame, turn_circle: float = TURN_CIRCLE_M, smooth: bool = True) -> DataFrame:
    """Points (field_id, path_id, point_no, x, y) of paths from their steps (point_no, x, y in bins, heading_deg). A path is a unit of work of at most MAX_STEPS points."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_no")
        p = rows[["x", "y"]].to_numpy()
        p = _simple(_smooth(p, rows["heading_deg"].to_numpy(), turn_circle) if smooth else p)
        return pd.DataFrame({"field_id": rows["field_id"].iloc[0], "path_id": rows["path_id"].iloc[0], "point_no": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1]})

    return steps.groupBy("field_id", "path_id").applyInPandas(one, "field_id int, path_id int, point_no int, x double, y double")


def paths(cells: DataFrame, headings: DataFrame, turn_circle: float = TURN_CIRCLE_M) -> tuple[DataFrame, DataFrame]:
    """(path points, bin to path) for all cut bins: numbered in raster order, routed along the headings, smoothed; routes of one bin are left out but their numbers are used up."""
    start = tables.place_in_raster(cells.where("existing > target").select(*KEY), "path_id")
    got = routes(start, successors(headings)).where(F.size("route") >= 2)
    steps = got.select("field_id", "path_id", F.posexplode("route").alias("point_no", "p")).select("field_id", "path_id", "point_no", c("p.x").alias("bx"), c("p.y").alias("by_")).join(headings.select(*KEY, "heading_deg"), KEY)
    steps = steps.withColumn("x", c("bx") + 0.5).withColumn("y", c("by_") + 0.5)
    points = smooth_paths(steps, turn_circle).withColumn("x", c("x") * BIN_M).withColumn("y", c("y") * BIN_M)
    return points, start.join(got.select("field_id", "path_id"), ["field_id", "path_id"], "left_semi")


def along(points: DataFrame) -> DataFrame:
    """Path points with the distance from the start and to the next point."""
    w = Window.partitionBy("field_id", "path_id").orderBy("point_no")
    back = F.sqrt(F.pow(c("x") - F.lag("x").over(w), 2) + F.pow(c("y") - F.lag("y").over(w), 2))
    got = points.withColumn("step_m", F.coalesce(back, F.lit(0.0)))
    return got.withColumn("run_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_x", F.lead("x").over(w)).withColumn("next_y", F.lead("y").over(w)).withColumn("next_m", F.lead("step_m").over(w))


def markers(points: DataFrame, every_m: float = 21.336) -> DataFrame:
    """Places every so many metres (70 feet) back from each path's end, with the path's direction there; at a bend, that of the step that begins there. A segment gives the marks that it holds, so nothing is joined."""
    path = Window.partitionBy("field_id", "path_id")
    seg = along(points).withColumn("total_m", F.max("run_m").over(path)).withColumn("next_run_m", F.lead("run_m").over(path.orderBy("point_no"))).where("next_m > 0")
    mark = lambda k: c("total_m") - k * every_m

    def last_from(at: str) -> Column:
        """Number of the last mark not before a place. The marks themselves decide, not the rounded quotient: so neighbours agree on what is whose."""
        k = F.floor((c("total_m") - c(at)) / every_m)
        return F.when(mark(k + 1) >= c(at), k + 1).when(mark(k) < c(at), k - 1).otherwise(k)

    first = F.when(c("next_run_m") >= c("total_m"), F.lit(0).cast("long")).otherwise(last_from("next_run_m") + 1)
    last = F.when(c("run_m") > 0, last_from("run_m")).otherwise(F.ceil(c("total_m") / every_m) - 1)
    seg = seg.withColumn("first", first).withColumn("last", last).where("last >= first").withColumn("k", F.explode(F.sequence("first", "last")))
    share = (mark(c("k")) - c("run_m")) / c("next_m")
    return seg.select("field_id", "path_id", c("k").alias("marker_no"), (c("x") + share * (c("next_x") - c("x"))).alias("x"), (c("y") + share * (c("next_y") - c("y"))).alias("y"), geo.vector_heading(c("next_x") - c("x"), c("next_y") - c("y")).alias("heading_deg"))


def path_of_bin(cells: DataFrame, bin_paths: DataFrame, points: DataFrame) -> DataFrame:
    """Points of the path of each bin that is still too high (current > target), with place, a point's number in its path's order: that is counted once a path, so what comes out, a row for each bin and point, is neither sorted nor moved."""
    order = Window.partitionBy("field_id", "path_id").orderBy("point_no")
    numbered = points.withColumn("place", F.row_number().over(order))
    return cells.where("current > target").join(bin_paths, KEY).join(numbered, ["field_id", "path_id"]).select(*KEY, "path_id", "point_no", "x", "y", "place")


def at_distance(points: DataFrame, metres: float) -> DataFrame:
    """(field_id, path_id, x, y, heading_deg): where each path is so many metres from its start, and which way it goes there; its end beyond that. Paths without length are left out."""
    seg = along(points).where("next_m > 0")
    last = F.max("run_m").over(Window.partitionBy("field_id", "path_id"))
    here = seg.withColumn("last", last).where(((c("run_m") <= metres) & (c("run_m") + c("next_m") > metres)) | ((c("run_m") == c("last")) & (c("run_m") + c("next_m") <= metres)))
    share = F.least(F.greatest((F.lit(metres) - c("run_m")) / c("next_m"), F.lit(0.0)), F.lit(1.0))
    place = [(c(a) + share * (c(f"next_{a}") - c(a))).alias(a) for a in ("x", "y")]
    return here.select("field_id", "path_id", *place, geo.vector_heading(c("next_x") - c("x"), c("next_y") - c("y")).alias("heading_deg"))


def sample_with_paths(cells: DataFrame, bin_paths: DataFrame, n: int, seed: str = "s") -> DataFrame:
    """n of the cells that own a path (bin_paths: field_id, bx, by_), by the order of a seeded hash."""
    return cells.join(bin_paths.select(*KEY), KEY, "left_semi").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "field_id", "bx", "by_"))).limit(n)
