"""Grid surfaces: gap filling, nearest points, local planes, masks, smoothing, the balanced design plane."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AROUND, BIN_M, FILL_RATIO, NEIGHBOURS, SMOOTH_SIGMA
from . import grid, nearest
from .loops import by_blocks, cut, fixpoint

c = F.col
KEY = grid.KEY


def fill_gaps(cells: DataFrame, column: str = "z") -> DataFrame:
    """Missing bins of a dense grid with at least two known 4-neighbours get the mean of the known ones; bins filled above or to the left count as known.

    A bin waits until its upper and left neighbours that can be filled are, so rounds give what one pass in raster order gives.
    """
    known = cells.select(*KEY, c(column).alias("v"), c(column).isNotNull().alias("given"))
    seen = grid.neighbours(known.where("given"), False, "v").groupBy(*KEY).agg(F.count("*").alias("n"))
    state = known.join(seen, KEY, "left").select(*KEY, "v", "given", (~c("given") & (F.coalesce("n", F.lit(0)) >= 2)).alias("open"))

    def step(now: DataFrame) -> DataFrame:
        sent = grid.neighbours(now.where("open OR v IS NOT NULL"), False, "v", "given", "open")
        earlier = c("k").isin(1, 3)  # above and left of the receiver
        got = sent.groupBy(*KEY).agg(F.max(earlier & c("open")).alias("wait"), F.avg(F.when(c("given") | earlier, c("v"))).alias("mean"))
        both = now.join(got, KEY, "left")
        ready = c("open") & ~F.coalesce("wait", F.lit(False))
        return both.select(*KEY, F.when(ready, c("mean")).otherwise(c("v")).alias("v"), "given", (c("open") & ~ready).alias("open"), ready.alias("changed"))

    return fixpoint(state, step, max_rounds=100_000).select(*KEY, c("v").alias(column))


def fill_gaps_8(cells: DataFrame, column: str = "z", least: int = 4, block: int = 64) -> DataFrame:
    """Missing bins with at least four known 8-neighbours get their mean; bins filled earlier in raster order count, so a bin waits for the four before it.

    Blocks work through their bins in raster order as far as their neighbours' state allows; a round is one step of the
    blocks' wavefront, not of the bins'.
    """
    state = cells.select(*KEY, c(column).alias("v"), c(column).isNull().alias("open"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, v = rows["bx"].to_numpy(), rows["by_"].to_numpy(), rows["v"].to_numpy(dtype=float, na_value=np.nan)
        own, waits = rows["own"].to_numpy(dtype=bool), rows["open"].to_numpy(dtype=bool).copy()
        at = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
        changed = np.zeros(len(v), bool)
        for i in np.lexsort((x, y)):
            if own[i] and waits[i]:
                around = [at.get((x[i] + dx, y[i] + dy)) for dx, dy in AROUND]
                if not any(j is not None and waits[j] for j in around[:4]):
                    known = [v[j] for j in around if j is not None and not np.isnan(v[j])]
                    v[i] = np.mean(known) if len(known) >= least else np.nan
                    waits[i], changed[i] = False, True
        out = rows.loc[own, KEY].copy()
        out["v"], out["open"], out["changed"] = pd.array(v[own], dtype="Float64"), waits[own], changed[own]
        return out

    def step(now: DataFrame) -> DataFrame:
        got = by_blocks(now, solve, "field_id int, bx int, by_ int, v double, open boolean, changed boolean", block)
        return got.withColumn("v", F.when(F.isnan("v"), F.lit(None)).otherwise(c("v")))

    return fixpoint(state, step, max_rounds=100_000).select(*KEY, c("v").alias(column))


def local_planes(neighbours: DataFrame) -> DataFrame:
    """(field_id, bx, by_, z): moving least squares from rows (dx, dy, d2, z) about each cell: weights 1 / (d2 + 0.5625 far2 + 1e-12), a small ridge, the plane's height at the cell; the weighted mean where the plane fails."""
    far = F.max("d2").over(Window.partitionBy(*KEY))
    rows = neighbours.withColumn("w", 1 / (c("d2") + 0.5625 * far + 1e-12))
    s = lambda x: F.sum(c("w") * x)
    dx, dy, z = c("dx"), c("dy"), c("z")
    m = rows.groupBy(*KEY).agg(F.sum("w").alias("s"), s(dx).alias("sx"), s(dy).alias("sy"), s(dx * dx).alias("sxx"), s(dx * dy).alias("sxy"), s(dy * dy).alias("syy"), s(z).alias("sz"), s(dx * z).alias("sxz"), s(dy * z).alias("syz"))
    ridge = F.greatest(F.lit(1e-12), 5e-6 * (c("s") + c("sxx") + c("syy")) / 3)
    a, b, d = c("sxx") + ridge, c("syy") + ridge, c("s") + ridge

    def det(m1: list) -> Column:
        (p, q, r), (t, u, v), (x, y, o) = m1
        return p * (u * o - v * y) - q * (t * o - v * x) + r * (t * y - u * x)

    whole = det([[a, c("sxy"), c("sx")], [c("sxy"), b, c("sy")], [c("sx"), c("sy"), d]])
    height = det([[a, c("sxy"), c("sxz")], [c("sxy"), b, c("syz")], [c("sx"), c("sy"), c("sz")]])
    return m.select(*KEY, F.coalesce(F.when(F.abs(whole) > 1e-18, height / whole), c("sz") / c("s")).alias("z"))


def design_surface(cells: DataFrame, points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The local-plane surface over cells (x, y) from survey points (field_id, seq, x, y, z)."""
    near = nearest.nearest_points(cells, points.select("field_id", "seq", "x", "y", "z"), k)
    return local_planes(near.withColumn("dx", c("px") - c("x")).withColumn("dy", c("py") - c("y")))


def box_blur(cells: DataFrame, radius: int, passes: int = 1, column: str = "z") -> DataFrame:
    """Moving mean over 2r + 1 bins along rows, then columns, of a dense rectangle; edge values repeat outside."""
    for _ in range(passes):
        for line, axis in (("by_", "bx"), ("bx", "by_")):
            w = Window.partitionBy("field_id", line)
            ordered = w.orderBy(axis)
            whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            first, last = F.first(column).over(whole), F.last(column).over(whole)
            lo, hi = F.first(axis).over(whole), F.last(axis).over(whole)
            inner = F.sum(column).over(ordered.rangeBetween(-radius, radius))
            edge = F.greatest(F.lit(0), radius - (c(axis) - lo)) * first + F.greatest(F.lit(0), radius - (hi - c(axis))) * last
            cells = cells.withColumn("__v", (inner + edge) / (2 * radius + 1)).withColumn(column, c("__v")).drop("__v")
    return cells


def gaussian(cells: DataFrame, sigma: float = SMOOTH_SIGMA, column: str = "z") -> DataFrame:
    """Separable Gaussian of radius ceil(4 sigma), weighted by what is valid; places outside the grid count as its edge. Cells without value stay without."""
    radius = math.ceil(4 * sigma)
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.exp(-i * i / (2 * sigma * sigma))).alias("w")) for i in range(-radius, radius + 1)])
    size = cells.groupBy("field_id").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by_").alias("y0"), F.max("by_").alias("y1"))
    now = cells.select(*KEY, column)
    for axis, lo, hi in (("bx", "x0", "x1"), ("by_", "y0", "y1")):
        asked = now.where(c(column).isNotNull()).select(*KEY).join(size, "field_id").withColumn("t", F.explode(taps))
        asked = asked.select("field_id", c("bx").alias("tx"), c("by_").alias("ty"), F.greatest(c(lo), F.least(c(hi), c(axis) + c("t.i"))).alias(axis), c("by_" if axis == "bx" else "bx"), c("t.w").alias("w"))
        got = asked.join(now.where(c(column).isNotNull()), KEY).groupBy("field_id", "tx", "ty").agg((F.sum(c("w") * c(column)) / F.sum("w")).alias(column))
        now = now.drop(column).join(got.select("field_id", c("tx").alias("bx"), c("ty").alias("by_"), column), KEY, "left")
    return now


def dilated(mask: DataFrame, passes: int = 1) -> DataFrame:
    """Cells (field_id, bx, by_) and those around them."""
    for _ in range(passes):
        mask = mask.select(*KEY).unionByName(grid.neighbours(mask).select(*KEY)).distinct()
    return mask


def eroded(mask: DataFrame, passes: int = 1) -> DataFrame:
    """Cells of which all eight neighbours are there, too."""
    for _ in range(passes):
        whole = grid.neighbours(mask).groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 8")
        mask = mask.select(*KEY).join(whole.select(*KEY), KEY, "left_semi")
    return mask


def labelled(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """cells with label: the smallest cell id (by_ * 2^20 + bx) of its connected component. Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of a component's extent."""
    start = cells.select(*KEY).withColumn("id", c("by_").cast("long") * (1 << 20) + c("bx")).withColumn("label", c("id"))

    def step(now: DataFrame) -> DataFrame:
        seen = grid.neighbours(now, diagonal, "label").groupBy(*KEY).agg(F.min("label").alias("seen"))
        low = now.join(seen, KEY, "left").withColumn("low", F.least("label", "seen"))
        # What a member saw is told to its label's cell, too, and from there to all with that label.
        root = low.groupBy("field_id", "label").agg(F.min("low").alias("root_low"))
        low = low.join(root, ["field_id", "label"]).withColumn("low", F.least("low", "root_low"))
        jump = low.select("field_id", c("id").alias("low"), c("low").alias("next"))
        return low.drop("root_low").join(jump, ["field_id", "low"], "left").select(*KEY, "id", F.least("low", "next").alias("label"), (F.least("low", "next") < c("label")).alias("changed"))

    return fixpoint(start, step).drop("id")


def largest_component(cells: DataFrame) -> DataFrame:
    """The largest 8-connected component of each field; of equal ones that first found in raster order."""
    named = labelled(cells)
    best = named.groupBy("field_id", "label").agg(F.count("*").alias("n")).groupBy("field_id").agg(F.max_by("label", F.struct("n", -c("label"))).alias("label"))
    return named.join(best, ["field_id", "label"], "left_semi").select(*KEY)


def filled_holes(mask: DataFrame) -> DataFrame:
    """mask and the background that no 4-connected path joins to the edge of the mask's rectangle."""
    size = mask.groupBy("field_id").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by_").alias("y0"), F.max("by_").alias("y1"))
    every = size.withColumn("bx", F.explode(F.sequence("x0", "x1"))).withColumn("by_", F.explode(F.sequence("y0", "y1")))
    empty = every.join(mask, KEY, "left_anti")
    named = labelled(empty, diagonal=False).join(size, "field_id")
    edge = (c("bx") == c("x0")) | (c("bx") == c("x1")) | (c("by_") == c("y0")) | (c("by_") == c("y1"))
    open_ = named.where(edge).select("field_id", "label").distinct()
    return mask.select(*KEY).unionByName(named.join(open_, ["field_id", "label"], "left_anti").select(*KEY))


def envelope(seen: DataFrame) -> DataFrame:
    """Bins between the first and the last observed one of each row, and of each column."""
    rows = seen.groupBy("field_id", "by_").agg(F.min("bx").alias("lo"), F.max("bx").alias("hi")).select("field_id", F.explode(F.sequence("lo", "hi")).alias("bx"), "by_")
    columns = seen.groupBy("field_id", "bx").agg(F.min("by_").alias("lo"), F.max("by_").alias("hi")).select("field_id", "bx", F.explode(F.sequence("lo", "hi")).alias("by_"))
    return rows.unionByName(columns).distinct()


def observed_mask(seen: DataFrame) -> DataFrame:
    """The valid bins of a survey without boundary: envelope, closed by two bins, holes filled, largest component, and what was observed."""
    closed = eroded(dilated(envelope(seen), 2), 2)
    return largest_component(filled_holes(closed)).unionByName(seen.select(*KEY)).distinct()


#: Heights between which the offset of a design plane is looked for.
LEAST_OFFSET_M, MOST_OFFSET_M = 0.0, 100.0


def balanced_plane(cells: DataFrame, a: float, b: float, ratio: float = FILL_RATIO, import_m3: float = 0.0, export_m3: float = 0.0, buckets: int = 1024, rounds: int = 4) -> DataFrame:
    """(field_id, c): the height at which the cut of the plane z = a E + b N + c over cells (x, y, z), and what is brought in, are ratio times the fill and what is taken away. c is null where no height from 0 to 100 m balances.

    The balance falls with c and is linear between the cells' residuals. Each round counts residuals in buckets of the
    bracket (a row a bucket) and keeps the bucket where the balance changes sign; in the last one it is a line.
    """
    net = (import_m3 - export_m3) / BIN_M**2
    r = cut(cells.select("field_id", (c("z") - a * c("x") - b * c("y")).alias("r")))
    lo, hi = LEAST_OFFSET_M, MOST_OFFSET_M

    def at(height: float) -> Column:
        d = c("r") - height
        return F.sum(F.greatest(d, F.lit(0.0))) - ratio * F.sum(F.greatest(-d, F.lit(0.0))) + net

    part = lambda where: (F.count_if(where), F.coalesce(F.sum(F.when(where, c("r"))), F.lit(0.0)))
    (n0, s0), (n1, s1) = part(c("r") < lo), part(c("r") >= hi)
    ends = cut(r.groupBy("field_id").agg(at(lo).alias("f0"), at(hi).alias("f1"), n0.alias("n_below"), s0.alias("s_below"), n1.alias("n_above"), s1.alias("s_above")))
    found = c("f0") * c("f1") < 0
    state = cut(ends.where(found).select("field_id", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), "n_below", "s_below", "n_above", "s_above"))
    for _ in range(rounds):
        step = (c("hi") - c("lo")) / buckets
        inside = r.join(state, "field_id").where((c("r") >= c("lo")) & (c("r") < c("hi")))
        hist = inside.groupBy("field_id", F.least(F.lit(buckets - 1), F.floor((c("r") - c("lo")) / step)).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("r").alias("s"))
        every = state.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(hist, ["field_id", "k"], "left").fillna({"n": 0, "s": 0.0})
        w = Window.partitionBy("field_id").orderBy("k")
        up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        every = every.select(
            "field_id", (c("lo") + c("k") * step).alias("lo"), (c("lo") + (c("k") + 1) * step).alias("hi"), (c("n_below") + F.coalesce(F.sum("n").over(up), F.lit(0))).alias("n_below"), (c("s_below") + F.coalesce(F.sum("s").over(up), F.lit(0.0))).alias("s_below"),
            (c("n_above") + F.coalesce(F.sum("n").over(down), F.lit(0))).alias("n_above"), (c("s_above") + F.coalesce(F.sum("s").over(down), F.lit(0.0))).alias("s_above"), "n", "s", "k",
        )
        balance = net + (c("s_above") - c("n_above") * c("hi")) - ratio * (c("n_below") * c("hi") - c("s_below")) - ratio * (c("n") * c("hi") - c("s"))  # at the bucket's upper end, where its cells are fill
        state = cut(every.where((balance <= 0) | (c("k") == buckets - 1)).groupBy("field_id").agg(F.min_by(F.struct("lo", "hi", "n_below", "s_below", "n_above", "s_above"), "k").alias("b")).select("field_id", "b.*"))
    rest = r.join(state, "field_id").where((c("r") >= c("lo")) & (c("r") < c("hi"))).groupBy("field_id").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    got = state.join(rest, "field_id", "left").fillna({"n": 0, "s": 0.0})
    # In the last bucket its cells count half as cut, half as fill: their width is beyond the precision of heights.
    n_up, s_up, n_down, s_down = c("n_above") + c("n") / 2, c("s_above") + c("s") / 2, c("n_below") + c("n") / 2, c("s_below") + c("s") / 2
    solved = got.select("field_id", ((s_up + ratio * s_down + net) / (n_up + ratio * n_down)).alias("c"))
    return ends.select("field_id").join(solved, "field_id", "left")


def plane_volumes(cells: DataFrame, plane: DataFrame, a: float, b: float) -> DataFrame:
    """Cut and fill in cubic metres against the plane."""
    d = c("z") - (a * c("x") + b * c("y") + c("c"))
    return cells.join(plane, "field_id").groupBy("field_id").agg((F.sum(F.greatest(d, F.lit(0.0))) * BIN_M**2).alias("cut_m3"), (F.sum(F.greatest(-d, F.lit(0.0))) * BIN_M**2).alias("fill_m3"))


def warped(cells: DataFrame, observed: DataFrame, alpha: float = 0.85, tolerance: float = 0.009) -> DataFrame:
    """A dense surface (z) drawn towards observed bins (field_id, bx, by_, seen): smoothed 3 x 2, a normalised residual warp (radius 12, 4 passes), up to 8 corrections of what exceeds the tolerance (8 x 3), smoothed 4 x 3, up to 6 corrections, and a clamp to the tolerance at observed bins."""

    def residuals(now: DataFrame) -> DataFrame:
        return now.join(observed, KEY, "left").withColumn("e", c("seen") - c("z"))

    def spread(now: DataFrame, e: Column, radius: int, passes: int) -> DataFrame:
        hit = e.isNotNull()
        both = now.withColumn("num", F.when(hit, e).otherwise(0.0)).withColumn("den", hit.cast("double"))
        both = box_blur(box_blur(both, radius, passes, "num"), radius, passes, "den")
        return cut(both.withColumn("z", c("z") + F.when(c("den") > 1e-12, alpha * c("num") / c("den")).otherwise(0.0)).select(*KEY, "z"))

    def corrected(now: DataFrame, most: int) -> DataFrame:
        for _ in range(most):
            over = residuals(now).withColumn("x", F.when(F.abs("e") > tolerance, c("e") - F.signum("e") * tolerance))
            if over.where("x IS NOT NULL").isEmpty():
                break
            now = spread(over, c("x"), 8, 3)
        return now

    now = cut(box_blur(cells.select(*KEY, "z"), 3, 2))
    now = spread(residuals(now), c("e"), 12, 4)
    now = corrected(now, 8)
    now = corrected(cut(box_blur(now, 4, 3)), 6)
    near = F.greatest(c("seen") - tolerance, F.least(c("seen") + tolerance, c("z")))
    return residuals(now).select(*KEY, F.when(c("seen").isNotNull(), near).otherwise(c("z")).alias("z"))

