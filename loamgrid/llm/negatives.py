"""Hard negatives by exact integer scores: matrix products in a residue number system."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, staged

ANCHOR_STEP, RELABEL_STEP, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares (in hundredths) of the positive's.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Rows of a tile on either side, and anchors of it that are scored at once.
TILE, SLICE = 8192, 128
#: Residues are at most 126 in size, so a float32 sum of so many products stays below 2^24, where it is exact.
SUM_LENGTH = (1 << 24) // (126 * 126)
#: Scaled components are held to this size, the largest that a float can reach; scores to a long.
LARGEST, LONG = 2.0**136, (1 << 63) - 1


def primes_for(bound: int) -> list[int]:
    """The primes from 251 down, three at least, whose product exceeds 2 * bound."""
    found, product, p = [], 1, 251
    while product <= 2 * bound or len(found) < 3:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def _residue(m: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers below 2^24 as residues from -(p - 1) / 2 to (p - 1) / 2; the first division may miss by one, the second can't."""
    inverse = np.float32(1 / p)
    r = m - p * np.rint(m * inverse)
    return r - p * np.rint(r * inverse)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of matrices of whole numbers held in doubles, exact.

    The matrices are multiplied modulo several small primes in float32. The symmetric mixed-radix digits of the Chinese
    remainder give the signed scores: int64 where the primes' product allows it, else Python integers held to a long.
    """
    largest = lambda m: int(np.abs(m).max()) if m.size else 0
    primes = primes_for(largest(a) * largest(b) * a.shape[1])
    wide = math.prod(primes) > LONG
    score = np.zeros((len(a), len(b)), object if wide else np.int64)
    digits: list[np.ndarray] = []
    radix = 1
    for p in primes:
        ra, rb = (np.fmod(m, p).astype(np.float32) for m in (a, b))
        ra, rb = _residue(ra, p), _residue(rb, p)
        r = np.zeros(score.shape, np.float32)
        for k in range(0, a.shape[1], SUM_LENGTH):
            r = _residue(r + _residue(ra[:, k : k + SUM_LENGTH] @ rb[:, k : k + SUM_LENGTH].T, p), p)
        for digit, q in zip(digits, primes, strict=False):
            r = _residue((r - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(r)
        score += r.astype(np.int64).astype(score.dtype) * radix
        radix *= p
    return np.clip(score, -LONG, LONG) if wide else score


def _sides(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]]:
    """Anchors and rows of a tile with their matrices, for each length of vectors; rows in the order of vec_id, none last."""
    rows = rows.sort_by([("vec_id", "ascending")])
    lengths = [np.diff(np.asarray(t.column("x").combine_chunks().offsets)) for t in (anchors, rows)]
    for n in np.intersect1d(*lengths):
        a, b = (t.filter(pa.array(of == n)) for t, of in zip((anchors, rows), lengths, strict=True))
        yield a, _matrix(a, n), b, _matrix(b, n)


def _matrix(t: pa.Table, length: int) -> np.ndarray:
    return np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, int(length))


def _highest(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.argsort(-score[at], kind="stable")][:k]
    return np.argsort(-score, kind="stable")[:k]


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """(row, score, vec_id): of each anchor the highest rows of its label in this tile, itself left out."""
    out: list[tuple] = []
    for a, ma, b, mb in _sides(anchors, rows):
        la, lb = np.asarray(a.column("label")), np.asarray(b.column("label"))
        ra, rb, ids = np.asarray(a.column("row")), np.asarray(b.column("row")), b.column("vec_id").to_pylist()
        for label in np.unique(la):
            mine, alike = np.flatnonzero(la == label), np.flatnonzero(lb == label)
            for k in range(0, len(mine) if len(alike) else 0, SLICE):
                part = mine[k : k + SLICE]
                for i, score in zip(part, exact_scores(ma[part], mb[alike]), strict=True):
                    best = [at for at in _highest(score, POSITIVES + 1) if rb[alike[at]] != ra[i]][:POSITIVES]
                    out += [(int(ra[i]), int(score[at]), ids[alike[at]]) for at in best]
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["row", "score", "vec_id"])


_FOUND = ["row", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Rows of _FOUND: of each anchor and positive the highest rows of other labels in this tile whose score lies in the window."""
    out: list[tuple] = []
    for a, ma, b, mb in _sides(anchors, rows):
        la, lb, ids = np.asarray(a.column("label")), np.asarray(b.column("label")), b.column("vec_id").to_pylist()
        ra, anchor_ids, positives = (a.column(c).to_pylist() for c in ("row", "vec_id", "positives"))
        for first in range(0, a.num_rows, SLICE):
            for i, score in enumerate(exact_scores(ma[first : first + SLICE], mb), first):
                windows = [(-(-LEAST_SHARE * p["score"] // 100), MOST_SHARE * p["score"] // 100) for p in positives[i]]
                least, most = min(low for low, _ in windows), max(high for _, high in windows)
                at = np.flatnonzero((score >= least) & (score <= most) & (lb != la[i]))
                at = at[np.argsort(-score[at], kind="stable")]
                falling = -score[at]
                for k, (p, (low, high)) in enumerate(zip(positives[i], windows, strict=True), 1):
                    start = int(np.searchsorted(falling, -high))
                    best = [j for j in at[start : start + NEGATIVES] if score[j] >= low]
                    out += [(ra[i], k, anchor_ids[i], p["vec_id"], p["score"], ids[j], int(score[j])) for j in best]
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(len(_FOUND))], names=_FOUND)


def eligible(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, x array<double>): rows with a label and finite components, relabelled where the rule says so, components scaled and floored."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Not floor(), whose result is a long: what is left of a remainder is exact in doubles of any size.
    low = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % RELABEL_STEP == 0, (label + 1) % LABELS).otherwise(label)
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda c: low(c * SCALE)).alias("x"))


def hard_negatives(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are dealt to tiles with all rows, about ``tile`` of each, and each is scored against all in two passes: the
    first finds an anchor's positives, the second the negatives in each positive's window. A tile returns a bounded
    number of rows an anchor, so no task holds more than a tile, whatever the labels' sizes.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths
    have no score. Repeated rows of a vec_id are rows of their own. A row without vec_id is no anchor and comes last
    among equal scores. An anchor without positives, or a positive whose window is empty, returns nothing. Scores that
    a long can't hold count as the nearest long. Other columns are left out; an empty table gives an empty result.
    """
    rows = staged(eligible(vectors), "negative-rows")
    is_anchor = F.col("vec_id") % ANCHOR_STEP == 0
    n = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    over, down = (max(1, -(-x // tile)) for x in (n["rows"], n["anchors"]))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    of = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    right = rows.toDF(*rows.columns).select("row", "vec_id", "label", "x", of(over).alias("i"), spread(down).alias("j")).groupBy("i", "j")

    def scored(anchors: DataFrame, fn, schema: str) -> DataFrame:
        left = anchors.withColumn("j", of(down)).withColumn("i", spread(over))
        return left.groupBy("i", "j").cogroup(right).applyInArrow(fn, schema)

    anchors = rows.where(is_anchor)
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    best = scored(anchors, _positives, "row long, score long, vec_id long").withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("k") <= POSITIVES)
    best = staged(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("positives")), "negative-positives")
    found = scored(anchors.join(best, "row"), _negatives, ", ".join(f"{c} long" for c in _FOUND))
    rank = F.row_number().over(Window.partitionBy("row", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    found = staged(found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES), "negatives")
    discard(rows, best)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


OP11_SQL = """WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
