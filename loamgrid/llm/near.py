"""Near-duplicate texts: five-word shingles at Jaccard similarity 0.8 or more.

Candidates are links of SimHash fingerprints by anchor points (``simhash.links``, up to 3 bits) and, since texts of
similarity 0.8 differ in more bits than anchors can cover, bands of min-hashes. Each is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from .common import components, staged

SEED = 42
WIDTH = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, more above.
BANDS = 20
ROWS = 5
#: Members of a band that one task compares; larger bands are cut into pairs of chunks.
CHUNK = 256
_PIECE = 1 << 12
_RANDOM = np.random.default_rng([SEED, BANDS, ROWS]).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_TIMES, _PLUS = _RANDOM[0] << np.uint64(1) | np.uint64(1), _RANDOM[1]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Different hashes of the text's shingles, sorted; a text of fewer words is one shingle, one without words none."""
    return np.unique(hashes(text, width))


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the text's shingles in order, repeats included."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    return np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n)


def bands(held: np.ndarray) -> list[int]:
    """A key for each band: the hash of ROWS min-hashes, as a signed number. Keys of different bands differ."""
    if not len(held):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(held), _PIECE):
        low = np.minimum(low, (held[i : i + _PIECE, None] * _TIMES + _PLUS).min(axis=0))
    low = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(low[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__h1", F.xxhash64("text")).withColumn("__h2", F.xxhash64(F.lit("again"), "text"))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h1, h2, node, fp, bands): h1 and h2 name the text, node its set of shingles, fp is its SimHash; texts without words are node 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, fps = [], [], []
            for text in batch.column("text"):
                every = hashes(text.as_py(), width)
                held = np.unique(every)
                fps.append(simhash.majority(every))
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED) if len(held) else 0)
                keys.append(bands(held))
            columns = [batch.column(c) for c in ("doc_id", "__h1", "__h2")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "node", "fp", "bands"])

    schema = docs.select("doc_id").schema.add("h1", "long").add("h2", "long").add("node", "long").add("fp", "long").add("bands", ArrayType(LongType()))
    return _named(docs).select("doc_id", "__h1", "__h2", "text").mapInArrow(made, schema)


def _sets(docs: DataFrame, texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, held): the shingles of each wanted node, from one of its texts."""
    one = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("t"))
    one = one.select("node", F.col("t.h1").alias("__h1"), F.col("t.h2").alias("__h2"))
    text = _named(docs.select("text")).join(one, ["__h1", "__h2"]).groupBy("node").agg(F.first("text").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"])

    return text.select("node", "text").mapInArrow(made, "node long, held array<long>")


def _forest(home: np.ndarray, node: np.ndarray, label: np.ndarray, held: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that join what is linked between rows of home and all rows, where labels (components so far) differ."""
    label, edges = label.copy(), []
    sizes = np.array([len(h) for h in held])
    _, ids = np.unique(np.concatenate(held), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(ids.max() + 1, np.int64)
    for i in home:
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[mine] = 0
        linked = np.flatnonzero((both >= similarity * (sizes + sizes[i] - both)) & (label != label[i]))
        for k in linked:
            if label[k] != label[i]:
                edges.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return edges


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or linked by anchors, no more than nodes and links of a spanning forest."""
    node = texts.where("size(bands) > 0").select("node", "fp").distinct()
    hub = staged(node.groupBy("fp").agg(F.min("node").alias("hub")), "near-fingerprints")
    same = node.join(hub, "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    far = simhash.links(hub.select("fp"))
    for side in ("a", "b"):
        far = far.join(hub.select(F.col("fp").alias(side), F.col("hub").alias(f"node_{side}")), side)
    return same.unionByName(far.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).where("a <> b"))


def links(docs: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links between nodes that share a band, or that fingerprints pair.

    First each pair of fingerprint_pairs is compared, and each member of a band is compared with the band's smallest node, each such pair once. Where that leaves a
    band in several components, the members outside the smallest node's are compared with all, in pairs of chunks; a
    chunk returns a spanning forest, so a large group of near copies adds as many edges as members.
    """
    nodes = texts.where("size(bands) > 0").groupBy("node").agg(F.first("bands").alias("bands"))
    members = staged(nodes.select("node", F.explode("bands").alias("key")), "near-bands")
    size = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    groups = staged(members.join(size, "key"), "near-groups")
    pairs = groups.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = staged(pairs.unionByName(fingerprint_pairs(texts)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    wanted = groups.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = staged(_sets(docs, texts, wanted, width), "near-sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("held").alias(f"held_{side}")), side)
    both = F.size(F.array_intersect("held_a", "held_b"))
    alike = both >= similarity * (F.size("held_a") + F.size("held_b") - both)
    fits = (F.size("held_a") >= similarity * F.size("held_b")) & (F.size("held_b") >= similarity * F.size("held_a"))
    first = staged(components(pairs.where(fits).where(alike).select("a", "b"), "near-edges"), "near-first")

    part = groups.where("n > 2").join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    told = part.groupBy("key").agg(F.min_by("label", "node").alias("home"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).where("l0 <> l1")
    # Bands of the same members are compared once.
    told = told.groupBy("n", "s").agg(F.min(F.struct("key", "home")).alias("k")).select("k.key", "k.home")
    part = staged(part.drop("n", "hub").join(told, "key").withColumn("stray", F.col("label") != F.col("home")), "near-rest")
    size = part.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cm"), F.ceil(F.count_if("stray") / chunk).cast("int").alias("cs"))
    rows = part.join(size, "key")
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    as_home = rows.where("stray").select("key", place("cs").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cm") - 1)).alias("j"), "node", "label", F.lit(True).alias("is_home"))
    as_member = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("i"), place("cm").alias("j"), "node", "label", F.lit(False).alias("is_home"))
    meet = as_home.unionByName(as_member).groupBy("key", "i", "j", "node", "label").agg(F.max("is_home").alias("is_home")).join(sets, "node")
    meet = meet.groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "label", "is_home", "held")).alias("rows"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for group in batch.column("rows"):
                s = group.values
                home = np.flatnonzero(np.asarray(s.field("is_home").to_numpy(zero_copy_only=False), bool))
                held = [np.asarray(h.values) for h in s.field("held")]
                edges += _forest(home, np.asarray(s.field("node")), np.asarray(s.field("label")), held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rest = meet.select("rows").mapInArrow(linked, "a long, b long")
    return first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest)


def grouped(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h1, h2, component) of each row; texts of one set of shingles, and texts without words, are one node."""
    texts = staged(sketches(docs, width), "near-texts")
    comp = staged(components(links(docs, texts, width, similarity), "near-edges"), "near-components")
    return texts.drop("bands", "fp").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row for each group of near-duplicates: that of the smallest doc_id, null being the largest, then of the smallest hash of the text. Ids need not be there nor differ."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    first = grouped(docs, width, similarity).groupBy("component").agg(F.min(row).alias("f")).select(F.col("f.doc_id").alias("__first"), F.col("f.h1").alias("__f1"), F.col("f.h2").alias("__f2"))
    key = F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2"))
    got = _named(docs).join(first, key, "left_semi")
    # Rows of one doc_id and text are in one group.
    place = Window.partitionBy("doc_id", "__h1", "__h2").orderBy("doc_id")
    return got.withColumn("__row", F.row_number().over(place)).where("__row = 1").select(*docs.columns)
