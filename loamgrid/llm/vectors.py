"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, read, staged

THRESHOLD = 0.95
#: Each pass has its own 62 random hyperplanes. There are so many that a lone pair at the threshold is found with this
#: probability, and at least LEAST_PASSES; a vector is compared with WINDOW neighbours in each.
RECALL = 0.999
LEAST_PASSES = 16
WINDOW = 64
SEED = 20_24
#: Rows of a sorted pass that are compared as one block, and rows of a component that make a chunk.
BLOCK = 512
CHUNK = 1024
_BITS = 62


def _planes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, passes * _BITS))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes over n vectors: a pair at the threshold shares the leading log2(n / window) signs of a pass, and so a window, with probability (1 - angle / pi) to that power."""
    bits = max(1.0, math.log2(max(n, 1) / window))
    hit = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return LEAST_PASSES if hit >= 1 else max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): vectors that are not null or zero and have finite components only."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(good)


def _forest(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join each row of a symmetric link matrix to the first row of its component."""
    done, edges = np.zeros(len(ids), bool), []
    for i in np.flatnonzero(near.any(axis=1)):
        if done[i]:
            continue
        rows = np.array([i])
        while len(rows):
            done[rows] = True
            rows = np.flatnonzero(near[rows].any(axis=0) & ~done)
            edges += [(int(ids[i]), int(ids[r])) for r in rows]
    return edges


def _unit(lists: pa.Array) -> list[np.ndarray]:
    """Each list of vectors as a matrix of unit rows; None where lengths differ."""
    return [(m := np.stack([np.asarray(v.values) for v in x])) / np.linalg.norm(m, axis=1, keepdims=True) for x in lists]


def candidate_edges(classes: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """Verified edges (a, b) between classes (rep, dim, v) found within the windows of any pass.

    In a pass vectors are sorted by the signs of 62 random projections, read as one number. Sorted rows are cut into
    blocks of BLOCK that also hold the ``window`` rows before them, and a block returns a spanning forest of the pairs
    that it has verified, so a dense group adds as many edges as rows.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                m = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                signs = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ _planes(int(dim), passes) > 0
                for p in range(passes):
                    key = signs[:, p * _BITS : (p + 1) * _BITS] @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), p, np.int32)), part.column("dim"), pa.array(key), part.column("rep"), part.column("v")], names=["pass", "dim", "key", "rep", "v"])

    rows = classes.select("rep", "dim", "v").mapInArrow(keyed, "pass int, dim int, key long, rep long, v array<double>")
    n = partitions(rows.sparkSession)
    order = ["pass", "dim", "key", "rep"]
    # The place of a row is only sure once the sorted partitions are written.
    run = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "vector-passes")
    before, sums = [], 0
    counts = {r["part"]: r["n"] for r in run.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    for p in range(max(counts, default=-1) + 1):
        before.append(sums)
        sums += counts.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("part") + 1)
    run = run.withColumn("place", offset + F.col("at"))
    here = F.floor(F.col("place") / BLOCK)
    near_end = F.col("place") % BLOCK >= BLOCK - window
    run = run.withColumn("block", F.explode(F.when(near_end, F.array(here, here + 1)).otherwise(F.array(here))))
    groups = run.groupBy("block").agg(F.collect_list(F.struct("place", "pass", "dim", "rep", "v")).alias("rows"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for block in batch.column("rows"):
                s = block.values
                kind = np.asarray(s.field("pass")).astype(np.int64) << 32 | np.asarray(s.field("dim"))
                place, rep, vectors = np.asarray(s.field("place")), np.asarray(s.field("rep")), s.field("v")
                for k in np.unique(kind):
                    at = np.flatnonzero(kind == k)
                    at = at[np.argsort(place[at])]
                    (m,) = _unit([vectors.take(pa.array(at))])
                    near = m @ m.T >= threshold
                    i = np.arange(len(at))
                    near &= (np.abs(i[:, None] - i[None, :]) <= window) & (i[:, None] != i[None, :])
                    edges += _forest(near, rep[at])
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in edges], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return groups.select("rows").mapInArrow(verified, "a long, b long")


def links_within(members: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(rep, linked): for each class of a component, how many vectors of other classes link to it.

    members: (component, rep, n, v). All pairs of a component are compared, but counted where they are compared: a
    component is dealt out as pairs of chunks of about ``chunk`` classes, and each group returns one row a class.
    """
    size = members.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    rows = members.join(size, "component").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = rows.groupBy("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list(F.struct("mine", "rep", "n", "v")).alias("rows"), F.min("mine").alias("low"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for block, i, j in zip(batch.column("rows"), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                s = block.values
                mine, rep, n = (np.asarray(s.field(c)) for c in ("mine", "rep", "n"))
                (m,) = _unit([s.field("v")])
                near = m @ m.T >= threshold
                near &= rep[:, None] != rep[None, :] if i == j else mine[:, None] != mine[None, :]
                reps.append(rep)
                counts.append(near @ n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (reps, counts)], names=["rep", "linked"])

    found = groups.select("rows", "i", "j").mapInArrow(counted, "rep long, linked long")
    return found.groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding).

    Equal vectors (by a 128-bit hash of the components) are one class. The passes join classes into components; then
    all pairs inside a component are counted, so only a link between two components that no pass joined can be missed.
    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Repeated rows of a vec_id are vectors of their own; a class without any vec_id has no links. The number of
    passes follows the number of classes. Other columns are left out; an empty table stays empty.
    """
    good = usable(vectors)
    hashed = good.select("vec_id", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("again"), "v").alias("h2"), "v")
    classes = staged(hashed.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "vector-classes")
    named = classes.where("rep IS NOT NULL")
    passes = passes or passes_for(named.count(), threshold, window)
    comp = staged(components(candidate_edges(named, threshold, passes, window), "vector-edges"), "vector-components")
    members = classes.join(comp, classes.rep == comp.id).select("component", "rep", "n", "v")
    counted = links_within(members, threshold)
    told = classes.drop("v").join(comp, classes.rep == comp.id, "left").drop("id").join(counted, "rep", "left")
    told = told.select("dim", "h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = hashed.drop("v").join(told, ["dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    v = F.col("embedding").cast("array<double>")
    bad = vectors.where(v.isNull() | ~F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
