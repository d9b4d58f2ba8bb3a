"""SimHash near-duplicates by anchor points (fuzzy joins by covering codes, Afrati et al. 2012)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, staged

SEED = 42
MAX_DISTANCE = 3
#: Members of an anchor that one task compares with one another; larger anchors are cut into pairs of chunks.
CHUNK = 1024
_PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The text's SimHash as an unsigned number: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set that are set in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        ones += np.unpackbits(hashes[i : i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(made, docs.select("doc_id").schema.add("fp", "long"))


#: Anchors are the words of the Hamming code of 31 bits, whose covering radius is 1. Bit j of a word's syndrome is the
#: parity of the bits at places (1 to 31) that have bit j set.
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def anchors(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (anchor, fp): each fingerprint at its nearest anchor, and at all others within radius 1 + 1.

    64 bits are two halves; of at most 3 differing bits one half has at most 1, and so have 31 bits of it. There the
    code covers: one of the pair is within 1 of its anchor, the other within 2 of the same one. The code is perfect,
    so each word has one anchor within 1 and 15 or none at distance 2.
    """
    half = fps.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    half = half.withColumn("w", F.shiftrightunsigned(F.col("fp"), 0).bitwiseAND(F.lit(0x7FFFFFFF)))
    half = half.withColumn("w", F.when(F.col("half") == 0, F.col("w")).otherwise(F.shiftrightunsigned(F.col("fp"), 32).bitwiseAND(F.lit(0x7FFFFFFF))).cast("long"))
    syndrome: Column = F.lit(0)
    for j, mask in enumerate(_PARITY):
        syndrome = syndrome + F.bit_count(F.col("w").bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    half = half.withColumn("s", syndrome.cast("int"))
    key = lambda word: F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(word)
    bit = "shiftleft(1L, {} - 1)"
    home = half.select(key(F.expr(f"w ^ if(s = 0, 0L, {bit.format('greatest(s, 1)')})")).alias("anchor"), "fp")
    pairs = half.where("s <> 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(31)))).where("i <> s AND i < (i ^ s)")
    away = pairs.select(key(F.expr(f"w ^ {bit.format('i')} ^ {bit.format('(i ^ s)')}")).alias("anchor"), "fp")
    return home, away


def _forest(home: np.ndarray, member: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked between home and member, one less than there are different fingerprints."""
    # Of signed numbers bitwise_count counts the bits of the absolute value.
    near = np.bitwise_count(home.view(np.uint64)[:, None] ^ member.view(np.uint64)[None, :]) <= distance
    seen, edges = np.zeros(len(member), bool), []
    done = np.zeros(len(home), bool)
    for i in range(len(home)):
        if done[i]:
            continue
        rows = np.array([i])
        while len(rows):
            done[rows] = True
            new = near[rows].any(axis=0) & ~seen
            seen |= new
            edges += [(home[i], m) for m in member[new]] + [(home[i], h) for h in home[rows]]
            rows = np.flatnonzero(near[:, new].any(axis=1) & ~done) if new.any() else rows[:0]
    return list({(int(a), int(b)) for a, b in edges if a != b})


def links(fps: DataFrame, distance: int = MAX_DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between different fingerprints (fp, each once) whose components are those of all links.

    Members of one anchor are compared with one another but only a spanning forest of them is returned, so a large
    group of near copies adds as many edges as members. Anchors of over ``chunk`` fingerprints are cut into chunks,
    and each pair of chunks is a group of its own.
    """
    if distance > MAX_DISTANCE:
        raise ValueError("the code covers up to 3 differing bits")
    home, away = anchors(fps)
    visiting = away.join(home.select("anchor"), "anchor", "left_semi")
    members = staged(home.withColumn("is_home", F.lit(1)).unionByName(visiting.withColumn("is_home", F.lit(0))), "simhash-members")
    size = members.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("is_home").alias("n_home")).where("n > 1 AND n_home > 0")
    size = size.select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("cm"), F.ceil(F.col("n_home") / chunk).cast("int").alias("ch"))
    rows = members.join(size, "anchor")
    mine = F.pmod(F.xxhash64("fp"), F.col("ch")).cast("int")
    as_home = rows.where("is_home = 1").select("anchor", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cm") - 1)).alias("j"), "fp", F.lit(1).alias("is_home"))
    as_member = rows.select("anchor", F.explode(F.sequence(F.lit(0), F.col("ch") - 1)).alias("i"), F.pmod(F.xxhash64("fp"), F.col("cm")).cast("int").alias("j"), "fp", F.lit(0).alias("is_home"))
    groups = as_home.unionByName(as_member).groupBy("anchor", "i", "j").agg(F.collect_list(F.when(F.col("is_home") == 1, F.col("fp"))).alias("home"), F.collect_list(F.when(F.col("is_home") == 0, F.col("fp"))).alias("member"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for h, m in zip(batch.column("home"), batch.column("member"), strict=True):
                edges += _forest(np.asarray(h.values), np.asarray(m.values), distance)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.where("size(home) > 0 AND size(member) > 0").select("home", "member").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most ``distance`` differing bits reach.

    Texts without words (null, empty) have fingerprint zero and link like any other. Copies share a fingerprint and
    are one node. Repeated rows of a doc_id give repeated rows; rows without doc_id never name a component unless it
    has no other. Whole texts count, however long; other columns are left out, and an empty table stays empty.
    """
    fp = staged(fingerprints(docs, width), "simhash-fp")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(nodes.select("fp"), distance), "simhash-edges")
    named = nodes.join(comp, nodes.fp == comp.id, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = staged(named, "simhash-nodes")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return fp.join(named.join(lowest, "component").select("fp", "component_id"), "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
