"""Drainage: depressions, receivers, sinks, spills, ponds, flow accumulation."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AROUND
from . import grid, surface
from .loops import by_blocks, cut

c = F.col
KEY = grid.KEY


def with_edge(dem: DataFrame) -> DataFrame:
    """dem with edge: whether a cell lies on its field's rectangle."""
    size = dem.groupBy("field_id").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by_").alias("y0"), F.max("by_").alias("y1"))
    on = (c("bx") == c("x0")) | (c("bx") == c("x1")) | (c("by_") == c("y0")) | (c("by_") == c("y1"))
    return dem.join(size, "field_id").withColumn("edge", on).drop("x0", "x1", "y0", "y1")


#: The place outside of a field, to which its rectangle's cells drain; other places are cells.
OUTSIDE = -(1 << 62)
#: Blocks on a side of the next larger block.
GROWTH = 8
_EDGES = "field_id int, a long, b long, height double"


def _place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) * (1 << 32) + y.astype(np.int64)


def _lowest_passes(a: list[int], b: list[int], height: list[float], kept: set[int]) -> list[tuple[int, int, float]]:
    """Edges between kept places with the same lowest passes as a graph of edges (a, b, height) has between them, one less than there are places at most: those by which Kruskal's tree joins two parts that both hold a kept place."""
    parent: dict[int, int] = {}
    stands: dict[int, int] = {}

    def root(u: int) -> int:
        top = u
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[u] != top:
            parent[u], u = top, parent[u]
        return top

    out = []
    for k in sorted(range(len(a)), key=height.__getitem__):
        u, v = root(a[k]), root(b[k])
        if u == v:
            continue
        p, q = stands.get(u, u if u in kept else None), stands.get(v, v if v in kept else None)
        if p is not None and q is not None:
            out.append((p, q, height[k]))
        parent[v] = u
        if (one := p if p is not None else q) is not None:
            stands[u] = one
    return out


def _borders(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One block: its lowest passes between the cells on its border and the outside, and the passes to the cells around it."""

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, z, own, edge = (rows[k].to_numpy() for k in ("bx", "by_", "z", "own", "edge"))
        place = _place(x, y)
        at = dict(zip(place.tolist(), range(len(place)), strict=True))
        inner: tuple[list, list, list] = ([], [], [])
        across = []
        border = own & ((x % size == 0) | (x % size == size - 1) | (y % size == 0) | (y % size == size - 1))
        for dx, dy in AROUND:
            there = _place(x + dx, y + dy).tolist()
            for i in np.flatnonzero(own).tolist():
                j = at.get(there[i])
                if j is None:
                    continue
                if not own[j]:
                    across.append((int(place[i]), there[i], max(z[i], z[j])))
                elif j > i:
                    for part, value in zip(inner, (int(place[i]), there[i], max(z[i], z[j])), strict=True):
                        part.append(value)
        for i in np.flatnonzero(own & edge).tolist():
            for part, value in zip(inner, (int(place[i]), OUTSIDE, z[i]), strict=True):
                part.append(value)
        found = _lowest_passes(*inner, {*place[border].tolist(), OUTSIDE}) + across
        return pd.DataFrame({"field_id": rows["field_id"].iloc[0] if len(rows) else pd.Series([], dtype=int), **{k: [f[i] for f in found] for i, k in enumerate(("a", "b", "height"))}})

    return borders


def _contracted(rows: pd.DataFrame) -> pd.DataFrame:
    """One larger block: its lowest passes between the places that have a pass to another one (kept), and the outside."""
    inner, kept = rows[~rows["kept"]], set(rows.loc[rows["kept"], "a"].tolist())
    found = _lowest_passes(inner["a"].tolist(), inner["b"].tolist(), inner["height"].tolist(), kept | {OUTSIDE})
    return pd.DataFrame({"field_id": rows["field_id"].iloc[0], **{k: [f[i] for f in found] for i, k in enumerate(("a", "b", "height"))}})


def _levelled(rows: pd.DataFrame) -> pd.DataFrame:
    """One larger block: the level of each place, from the outside and the places whose level is known (kept), over its lowest passes."""
    near: dict[int, list[tuple[int, float]]] = {}
    inner, known = rows[~rows["kept"]], rows[rows["kept"]]
    for a, b, h in zip(inner["a"].tolist(), inner["b"].tolist(), inner["height"].tolist(), strict=True):
        near.setdefault(a, []).append((b, h))
        near.setdefault(b, []).append((a, h))
    level = {OUTSIDE: -math.inf, **dict(zip(known["a"].tolist(), known["height"].tolist(), strict=True))}
    heap = [(h, u) for u, h in level.items()]
    heapq.heapify(heap)
    while heap:
        h, u = heapq.heappop(heap)
        if h > level[u]:
            continue
        for v, over in near.get(u, ()):
            if (new := max(h, over)) < level.get(v, math.inf):
                level[v] = new
                heapq.heappush(heap, (new, v))
    del level[OUTSIDE]
    return pd.DataFrame({"field_id": rows["field_id"].iloc[0], "a": list(level), "height": list(level.values())})


def _flood(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: heights to which water fills it, given the levels of its border's cells, by a priority flood."""
    x, y, z, level, edge = (rows[k].to_numpy() for k in ("bx", "by_", "z", "level", "edge"))
    place = _place(x, y)
    at = dict(zip(place.tolist(), range(len(place)), strict=True))
    best = np.where(edge, z, np.inf)
    best = np.fmin(best, np.maximum(level, z))
    heap = [(best[i], i) for i in np.flatnonzero(best < np.inf).tolist()]
    heapq.heapify(heap)
    around = [_place(x + dx, y + dy).tolist() for dx, dy in AROUND]
    while heap:
        h, i = heapq.heappop(heap)
        if h > best[i]:
            continue
        for there in around:
            j = at.get(there[i])
            if j is not None and (new := max(h, z[j])) < best[j]:
                best[j] = new
                heapq.heappush(heap, (new, j))
    out = rows[["field_id", "bx", "by_", "z"]].copy()
    out["filled"] = np.where(best < np.inf, best, z)
    return out


def spill_levels(dem: DataFrame, block: int = 128) -> DataFrame:
    """(field_id, a, height): the level to which water stands at the cells on the borders of blocks, by a graph of lowest passes (Barnes 2016).

    Each block keeps its lowest passes between border cells; blocks of GROWTH x GROWTH blocks do the same with those, until
    one holds the field. From there levels go down again. The passes over the data are two for each growth, whatever way
    the water takes; a task holds the borders of GROWTH x GROWTH blocks.
    """
    edges = cut(by_blocks(with_edge(dem), _borders(block), _EDGES, block))
    reach = dem.agg(F.max(F.abs("bx")).alias("x"), F.max(F.abs("by_")).alias("y")).first()
    extent = 2 * (max(reach["x"] or 0, reach["y"] or 0) + 1)
    size, inner = block, []
    while True:
        size *= GROWTH
        of = lambda p, size=size: F.when(c(p) == OUTSIDE, F.lit(None)).otherwise(F.struct(F.floor(F.shiftright(p, 32) / size).alias("x"), F.floor(F.pmod(c(p), F.lit(1 << 32)) / size).alias("y")))
        placed = edges.withColumn("at_a", of("a")).withColumn("at_b", of("b"))
        block_of = F.coalesce("at_a", "at_b")
        within = c("at_a").isNull() | c("at_b").isNull() | (c("at_a") == c("at_b"))
        last = size >= extent
        within = F.lit(True) if last else within
        block_of = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")) if last else block_of
        mine = cut(placed.where(within).select("field_id", block_of.alias("part"), "a", "b", "height", F.lit(False).alias("kept")))
        if last:
            inner.append((mine, None))
            break
        cross = placed.where(~within)
        ends = cut(cross.select("field_id", c("at_a").alias("part"), "a").unionByName(cross.select("field_id", c("at_b").alias("part"), c("b").alias("a"))).distinct())
        inner.append((mine, ends))
        marks = ends.select("field_id", "part", "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("height"), F.lit(True).alias("kept"))
        edges = cut(mine.unionByName(marks).groupBy("field_id", "part").applyInPandas(_contracted, _EDGES).unionByName(cross.select("field_id", "a", "b", "height")))
    levels = None
    for mine, ends in reversed(inner):
        rows = mine
        if ends is not None:
            known = ends.join(levels, ["field_id", "a"]).select("field_id", "part", "a", F.lit(None).cast("long").alias("b"), "height", F.lit(True).alias("kept"))
            rows = mine.unionByName(known)
        levels = cut(rows.groupBy("field_id", "part").applyInPandas(_levelled, "field_id int, a long, height double").groupBy("field_id", "a").agg(F.min("height").alias("height")))
    return levels


def filled(dem: DataFrame, block: int = 128) -> DataFrame:
    """dem (field_id, bx, by_, z; valid cells only) with filled: the height to which water stands before it runs off over the rectangle's edge; cells that no path joins to the edge keep their own.

    The levels of the blocks' border cells come from spill_levels; each block then floods once from its border.
    """
    dem = cut(dem.select(*KEY, "z").where("z IS NOT NULL"))
    levels = spill_levels(dem, block)
    place = c("bx").cast("long") * (1 << 32) + c("by_").cast("long")
    rows = with_edge(dem).withColumn("a", place).join(levels, ["field_id", "a"], "left").withColumnRenamed("height", "level").drop("a")
    rows = rows.withColumn("block_x", F.floor(c("bx") / float(block))).withColumn("block_y", F.floor(c("by_") / float(block)))
    return rows.groupBy("field_id", "block_x", "block_y").applyInPandas(_flood, "field_id int, bx int, by_ int, z double, filled double")


def sink_depths(dem: DataFrame, block: int = 128) -> DataFrame:
    return filled(dem, block).withColumn("depth", c("filled") - c("z"))


def receivers(dem: DataFrame) -> DataFrame:
    """dem with rx, ry: the neighbour of the steepest descent (ties: first in order), null where there is none."""
    length = F.when(c("k").isin(0, 2, 5, 7), math.sqrt(2.0)).otherwise(1.0)
    seen = grid.neighbours(dem.select(*KEY, c("z").alias("nz")), True, "nz")
    slopes = dem.select(*KEY, "z").join(seen, KEY).withColumn("slope", (c("z") - c("nz")) / length).where("slope > 0")
    step = F.element_at(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND]), c("k") + 1)
    best = slopes.groupBy(*KEY).agg(F.max_by(step, F.struct("slope", -c("k"))).alias("s"))
    return dem.join(best, KEY, "left").withColumn("rx", c("bx") + c("s.dx")).withColumn("ry", c("by_") + c("s.dy")).drop("s")


def terminals(flow: DataFrame) -> DataFrame:
    """(field_id, bx, by_, tx, ty): where each cell's water ends, by pointer doubling over receivers."""
    now = cut(flow.select(*KEY, F.coalesce("rx", "bx").alias("tx"), F.coalesce("ry", "by_").alias("ty")))
    while True:
        jump = now.select("field_id", c("bx").alias("tx"), c("by_").alias("ty"), c("tx").alias("ux"), c("ty").alias("uy"))
        after = cut(now.join(jump, ["field_id", "tx", "ty"]).select(*KEY, c("ux").alias("tx"), c("uy").alias("ty"), ((c("ux") != c("tx")) | (c("uy") != c("ty"))).alias("changed")))
        now = after.drop("changed")
        if after.where("changed").isEmpty():
            return now


def accumulated(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(field_id, bx, by_, flow): what reaches each cell of sources (amount) along weighted edges (bx, by_ -> rx, ry, share), itself included.

    Round k moves what has travelled 2^k steps on by as many more (doubling of the edge table), so rounds grow with the logarithm of the longest path.
    """
    flow = cut(sources.select(*KEY, c("amount").cast("double").alias("flow")))
    jump = cut(edges.select(*KEY, "rx", "ry", "share"))
    while not jump.isEmpty():
        moved = flow.join(jump, KEY).groupBy("field_id", c("rx").alias("bx"), c("ry").alias("by_")).agg(F.sum(c("flow") * c("share")).alias("more"))
        flow = cut(flow.join(moved, KEY, "left").select(*KEY, (c("flow") + F.coalesce("more", F.lit(0.0))).alias("flow")))
        two = jump.select("field_id", c("bx").alias("rx"), c("by_").alias("ry"), c("rx").alias("ux"), c("ry").alias("uy"), c("share").alias("s2"))
        jump = cut(jump.join(two, ["field_id", "rx", "ry"]).groupBy(*KEY, "ux", "uy").agg(F.sum(c("share") * c("s2")).alias("share")).select(*KEY, c("ux").alias("rx"), c("uy").alias("ry"), "share"))
    return flow


def runoff_accumulated(flow: DataFrame, runoff: float = 1.0) -> DataFrame:
    return accumulated(flow.where("rx IS NOT NULL").select(*KEY, "rx", "ry", F.lit(1.0).alias("share")), flow.select(*KEY, F.lit(runoff).alias("amount")))


def sink_regions(depths: DataFrame) -> DataFrame:
    """Cells with depth and their sink, numbered in each field by the sinks' first cells in raster order."""
    cells = surface.labelled(depths.where("depth > 0").select(*KEY))
    named = cells.select("field_id", "label").distinct().withColumn("sink", F.row_number().over(Window.partitionBy("field_id").orderBy("label")))
    return cells.join(named, ["field_id", "label"]).join(depths.select(*KEY, "z", "depth"), KEY).select(*KEY, "sink", "z", "depth")


def sinks(regions: DataFrame, dem: DataFrame, reach: DataFrame, cell_area: float, runoff_m: float) -> DataFrame:
    """One row a sink: capacity, what runs in (from cells whose terminal lies in it), spill height and the sink downstream.

    The spill is the lowest border: the higher of the two cells, or the sink's own at places without data; the water goes
    to the sink that holds the other cell of the lowest border (ties: cell, then order of neighbours), if any.
    """
    size = regions.groupBy("field_id", "sink").agg((F.sum("depth") * cell_area).alias("capacity"), F.count("*").alias("n_cells"))
    ends = regions.select("field_id", c("bx").alias("tx"), c("by_").alias("ty"), "sink")
    inflow = reach.join(ends, ["field_id", "tx", "ty"]).groupBy("field_id", "sink").agg((F.count("*") * cell_area * runoff_m).alias("inflow"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(AROUND)]))
    border = regions.select("field_id", "sink", "z", c("bx").alias("x"), c("by_").alias("y"), steps.alias("s")).withColumn("bx", c("x") + c("s.dx")).withColumn("by_", c("y") + c("s.dy"))
    other = dem.select(*KEY, c("z").alias("nz")).join(regions.select(*KEY, c("sink").alias("to")), KEY, "left")
    border = border.join(other, KEY, "left").where(c("to").isNull() | (c("to") != c("sink")))
    border = border.withColumn("escape", F.when(c("nz").isNull(), c("z")).otherwise(F.greatest("z", "nz")))
    spill = border.groupBy("field_id", "sink").agg(F.min("escape").alias("spill"), F.min_by(F.struct("to"), F.struct("escape", "y", "x", "s.k")).alias("d"))
    return size.join(inflow, ["field_id", "sink"], "left").fillna({"inflow": 0.0}).join(spill, ["field_id", "sink"], "left").select("field_id", "sink", "n_cells", "capacity", "inflow", "spill", c("d.to").alias("downstream"))


def cascaded(sink_rows: DataFrame) -> DataFrame:
    """Sinks with stored and lost: in order of spill and number each keeps what fits and passes the rest on; what goes to a sink that has had its turn, or to none, is lost.

    A sink waits only for those upstream with an earlier turn, so rounds follow the depth of that graph and all sinks of a
    level go together.
    """
    turn = F.struct("spill", "sink")
    s = sink_rows.withColumn("turn", turn)
    down = s.select("field_id", c("sink").alias("downstream"), c("turn").alias("next_turn"))
    s = s.join(down, ["field_id", "downstream"], "left").withColumn("passes", F.coalesce(c("next_turn") > c("turn"), F.lit(False)))
    state = cut(s.select("field_id", "sink", "capacity", "downstream", "passes", c("inflow").alias("got"), F.lit(False).alias("done"), F.lit(0.0).alias("stored"), F.lit(0.0).alias("lost"), "n_cells", "inflow", "spill"))
    while not state.where("NOT done").isEmpty():
        waits = state.where("NOT done AND passes").select("field_id", c("downstream").alias("sink")).distinct().withColumn("waits", F.lit(True))
        now = state.join(waits, ["field_id", "sink"], "left").withColumn("ready", ~c("done") & c("waits").isNull()).drop("waits")
        over = F.greatest(c("got") - c("capacity"), F.lit(0.0))
        sent = now.where("ready AND passes").groupBy("field_id", c("downstream").alias("sink")).agg(F.sum(over).alias("more"))
        now = now.join(sent, ["field_id", "sink"], "left")
        state = cut(now.select(
            "field_id", "sink", "capacity", "downstream", "passes", (c("got") + F.coalesce("more", F.lit(0.0))).alias("got"), (c("done") | c("ready")).alias("done"), F.when(c("ready"), F.least("got", "capacity")).otherwise(c("stored")).alias("stored"),
            F.when(c("ready") & ~c("passes"), over).otherwise(c("lost")).alias("lost"), "n_cells", "inflow", "spill",
        ))
    return state.drop("done", "got", "passes")


def pond_levels(regions: DataFrame, stored: DataFrame, cell_area: float) -> DataFrame:
    """(field_id, sink, level): the depth of a sink's cells that stays dry when it holds its stored volume. Closed form: with depths sorted falling and summed, (sum of the first i - volume / area) / i at the first i where it is not below the next depth."""
    w = Window.partitionBy("field_id", "sink").orderBy(c("depth").desc(), "by_", "bx")
    rows = regions.join(stored.select("field_id", "sink", "stored"), ["field_id", "sink"])
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("total", F.sum("depth").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.coalesce(F.lead("depth").over(w), F.lit(0.0)))
    level = (c("total") - c("stored") / cell_area) / c("i")
    return rows.where(level >= c("after") - 1e-12).groupBy("field_id", "sink").agg(F.greatest(F.min_by(level, "i"), F.lit(0.0)).alias("level"))


def pond_depths(regions: DataFrame, stored: DataFrame, cell_area: float) -> DataFrame:
    """Sink cells with pond: the water over each when the sink holds its stored volume."""
    rows = regions.join(stored.select("field_id", "sink"), ["field_id", "sink"]).join(pond_levels(regions, stored, cell_area), ["field_id", "sink"], "left")
    return rows.select(*KEY, "sink", F.greatest(c("depth") - F.coalesce("level", F.lit(0.0)), F.lit(0.0)).alias("pond"))


def ponding(dem: DataFrame, runoff_m: float, cell_m: float, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """(ponds by cell, sinks) of a rainfall's runoff on a surface."""
    valid = dem.where("z IS NOT NULL")
    depths = cut(sink_depths(valid, block))
    regions = cut(sink_regions(depths))
    reach = terminals(receivers(valid))
    rows = cascaded(sinks(regions, valid, reach, cell_m * cell_m, runoff_m))
    return pond_depths(regions, rows, cell_m * cell_m), rows


#: The triangular facets of a cell as (neighbour along an axis, neighbour on the diagonal), by their places in AROUND.
FACETS = ((4, 2), (1, 2), (1, 0), (3, 0), (3, 5), (6, 5), (6, 7), (4, 7))


def d_infinity(dem: DataFrame) -> DataFrame:
    """Weighted edges (share) of each cell: the steepest of eight facets, split by angle between its two cells (Tarboton 1997)."""
    seen = grid.neighbours(dem.select(*KEY, c("z").alias("nz")), True, "nz")
    wide = dem.select(*KEY, "z").join(seen.groupBy(*KEY).agg(*[F.max(F.when(c("k") == k, c("nz"))).alias(f"n{k}") for k in range(8)]), KEY, "left")
    facets = []
    for f, (a, d) in enumerate(FACETS):
        s1, s2 = c("z") - c(f"n{a}"), c(f"n{a}") - c(f"n{d}")
        r = F.atan2(s2, s1)
        angle = F.when(r < 0, 0.0).when(r > math.pi / 4, math.pi / 4).otherwise(r)
        slope = F.when(r < 0, s1).when(r > math.pi / 4, (c("z") - c(f"n{d}")) / math.sqrt(2.0)).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        facets.append(F.when(s1.isNotNull() & s2.isNotNull(), F.struct(slope.alias("slope"), F.lit(-f).alias("f"), angle.alias("angle"), F.lit(a).alias("a"), F.lit(d).alias("d"))))
    best = F.array_max(F.filter(F.array(*facets), lambda x: x.isNotNull() & (x["slope"] > 0)))
    step = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND])
    share = c("b.angle") / (math.pi / 4)
    two = F.array(F.struct(c("b.a").alias("k"), (1 - share).alias("share")), F.struct(c("b.d").alias("k"), share.alias("share")))
    got = wide.select(*KEY, best.alias("b")).where("b IS NOT NULL").select(*KEY, F.explode(two).alias("e")).where("e.share > 1e-12").withColumn("s", F.element_at(step, c("e.k") + 1))
    return got.select(*KEY, (c("bx") + c("s.dx")).alias("rx"), (c("by_") + c("s.dy")).alias("ry"), c("e.share").alias("share"))


def flow_cells(dem: DataFrame) -> DataFrame:
    """Number of cells that drain through each cell, itself included."""
    return accumulated(d_infinity(dem), dem.select(*KEY, F.lit(1.0).alias("amount")))
