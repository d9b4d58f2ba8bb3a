"""Removal of long repeated substrings with a logarithmic family of suffix indexes.

Whole suffix arrays of a corpus would be a row a byte. The index holds a sample of the suffixes that no repeat of at
least MATCH bytes can miss: of each string of MATCH bytes the suffix whose first GRAM bytes hash lowest. Equal strings
sample the same place, so two equal strings always meet at a sampled suffix with equal first GRAM bytes. Each batch of
documents gets a table of sampled suffixes in the order of these bytes' hash (only equality of them counts), is scanned
against the tables of earlier batches, and tables of equal size merge, as in the logarithmic method of Bentley and Saxe.
Where a scan finds equal suffixes with unequal surroundings, dense suffix arrays of the surroundings decide byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, read, staged

MATCH, GRAM = 200, 32
#: The number of batches grows with the logarithm of the bytes: one for each doubling beyond so many, two at least.
FIRST_BATCH = 1 << 25
#: Bytes of documents whose suffixes are sampled together, bytes of surroundings that share a dense suffix array, and
#: different surroundings of one suffix beyond which they are compared as hashed windows instead.
SAMPLE_BLOCK, ARRAY_BLOCK, HOT = 1 << 20, 1 << 21, 8192
_PLACE = np.uint64((1 << 22) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place, by doubling polynomial hashes, then mixed."""
    h, width = b.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        power = np.uint64(pow(_MULTIPLIER, width, 1 << 64))
        h = h[:-width] * power + h[width:]
        width *= 2
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def sampled(block: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, gram hash, hash of the surroundings) of the runs of MATCH-byte strings that share a sampled suffix.

    block: texts on end, ends: where each ends. A run is ``count`` strings at consecutive places from ``first`` on, inside
    one text; its surroundings are the bytes that they cover.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    b = np.frombuffer(block, np.uint8)
    if len(b) < MATCH:
        return none
    gram = _gram_hashes(b)
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, want = 1, MATCH - GRAM + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(b) - MATCH + 1], low[want - width : want - width + len(b) - MATCH + 1])
    at = (low & _PLACE).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(b) + 1, np.int64)  # starts of strings that end in the same text
    long = ends - starts >= MATCH
    inside[starts[long]] += 1
    inside[ends[long] - MATCH + 1] -= 1
    good = np.cumsum(inside)[: len(at)] > 0
    new = good.copy()
    new[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    stop = np.concatenate((first[1:], [len(good)])) if len(first) else first
    count = np.add.reduceat(good, first, dtype=np.int64) if len(first) else stop
    digest = xxhash.xxh3_64_intdigest
    around = np.array([digest(block[p : p + n - 1 + MATCH]) for p, n in zip(first.tolist(), count.tolist(), strict=True)], np.uint64)
    return first, count, gram[at[first]].view(np.int64), around.view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """(h, f, doc_id, text_key, start, n) for the runs of each whole text: hash of the sampled suffix, hash of the surroundings, place of the first string, number of strings."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column("doc_id"), batch.column("text_key")
            block: list[bytes] = []
            index: list[int] = []
            offset: list[int] = []

            def flush() -> pa.RecordBatch:
                ends = np.cumsum([len(x) for x in block])
                first, n, h, f = sampled(b"".join(block), ends)
                part = np.searchsorted(ends, first, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                row = pa.array(np.array(index, np.int64)[part])
                start = first - begin[part] + np.array(offset, np.int64)[part]
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), doc.take(row), key.take(row), pa.array(start), pa.array(n)], names=["h", "f", "doc_id", "text_key", "start", "n"])

            size = 0
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                for o in range(0, max(len(raw) - MATCH + 1, 0), SAMPLE_BLOCK):  # pieces of a very long text share MATCH - 1 bytes
                    block.append(raw[o : o + SAMPLE_BLOCK + MATCH - 1])
                    index.append(i)
                    offset.append(o)
                    size += len(block[-1])
                    if size >= SAMPLE_BLOCK:
                        yield flush()
                        block, index, offset, size = [], [], [], 0
            if block:
                yield flush()

    schema = docs.select(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("f"), "doc_id", "text_key", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n")).schema
    return docs.select("doc_id", "text_key", "text").mapInArrow(found, schema)


class SuffixIndex:
    """Tables (h, n, low, high) of sampled suffixes in levels: how often each occurs, and the range of its surroundings' hashes.

    ``add`` makes the table of a batch, scans it against itself and each level, keeps what it finds in ``hits``, and merges
    levels of equal size, so that a suffix is rewritten once for each doubling of the index.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.runs: list[DataFrame] = []
        self.hits: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        runs = staged(suffixes(docs), "suffix-runs")
        table = staged(runs.groupBy("h").agg(F.count("*").alias("n"), F.min("f").alias("low"), F.max("f").alias("high")).sortWithinPartitions("h"), "suffix-level")
        found = table.where("n > 1").select("h", "low", "high")
        for _, level in self.levels:
            old = level.select("h", F.col("low").alias("low_"), F.col("high").alias("high_"))
            found = found.unionByName(table.join(old, "h").select("h", F.least("low", "low_").alias("low"), F.greatest("high", "high_").alias("high")))
        self.runs.append(runs)
        self.hits.append(staged(found, "suffix-hits"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            both = level.unionByName(table).groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            merged = staged(both.sortWithinPartitions("h"), "suffix-level")
            discard(level, table)
            table, size = merged, size * 2
        self.levels.append((size, table))

    def repeated(self) -> DataFrame:
        """(h, low, high) of all suffixes that occur more than once."""
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        return hits.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def all_runs(self) -> DataFrame:
        runs = self.runs[0]
        for more in self.runs[1:]:
            runs = runs.unionByName(more)
        return runs


def classes(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of the MATCH bytes at each of starts among all of them: a suffix array cut at that depth, by prefix doubling from 8 bytes."""
    n = len(b)
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1]))).astype(np.uint64)
        return rank

    rank, depth = ranked(key), 8
    while depth * 2 <= MATCH:
        after = np.zeros(n, np.uint64)
        after[:-depth] = rank[depth:]
        rank, depth = ranked(rank << np.uint64(32) | after), depth * 2
    return ranked(rank[starts] << np.uint64(32) | rank[starts + MATCH - depth])


def _repeated_places(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(h, f, first, last) of runs of repeated strings in the surroundings of rows (h, f, n, copies, bytes)."""
    sizes = np.array([len(r[4]) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = np.array([r[2] for r in rows])
    starts = np.concatenate([np.arange(s, s + k) for s, k in zip(begin, n, strict=True)])
    kind = classes(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), starts)
    twice = np.bincount(kind.astype(np.int64))[kind.astype(np.int64)] > 1
    at = 0
    for (h, f, k, copies, _) in rows:
        hit = np.concatenate(([0], np.ones(k, int) if copies > 1 else twice[at : at + k].astype(int), [0]))
        at += k
        edge = np.diff(hit)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        if len(first):
            yield h, f, first.tolist(), last.tolist()


_PLACES = "h long, f long, first array<long>, last array<long>"


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h; dense suffix arrays hold whole groups of h."""
    schema = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = list(_repeated_places(rows))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t.type) for i, t in enumerate(schema)], schema=schema)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("h", "f", "n", "copies", "around")], strict=True):
            if rows and size >= ARRAY_BLOCK and row[0] != rows[-1][0]:
                yield flush()
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield flush()


def repeated_spans(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """(doc_id, text_key, first, last): spans of bytes [first, last) of docs (doc_id, text_key, text) that lie in a repeated string of MATCH bytes."""
    spark = docs.sparkSession
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        batches = max(2, (size // FIRST_BATCH).bit_length())
    index = SuffixIndex()
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)) == k))
    # Staged on its own, so that the join reads two shuffles and a hot suffix can be split.
    repeated = staged(index.repeated(), "suffix-repeated")
    runs = staged(index.all_runs().join(repeated, "h").withColumn("alike", F.col("low") == F.col("high")).drop("low", "high"), "suffix-repeats")
    discard(*index.runs, *index.hits, *[level for _, level in index.levels])
    # All surroundings alike: every string of the run is repeated. Else one of each different surroundings is looked into.
    alike = runs.where("alike").select("doc_id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1 + MATCH).alias("last"))
    unlike = runs.where("NOT alike")
    one = unlike.groupBy("h", "f").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "n")).alias("at"))
    one = staged(one.select("h", "f", "copies", "at.*"), "suffix-unlike")
    kinds = one.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = one.join(kinds, "h", "left").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "f", "copies", "start", "n", "hot")).alias("runs"))
    texts = docs.select("doc_id", "text_key", "text")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    held = texts.join(wanted, same(texts, wanted)).select("text", "runs")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, runs_of in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode()
                rows += [(r["h"], r["f"], r["n"], r["copies"], bool(r["hot"]), raw[r["start"] : r["start"] + r["n"] - 1 + MATCH]) for r in runs_of]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["h", "f", "n", "copies", "hot", "around"])

    around = staged(held.mapInArrow(cut, "h long, f long, n long, copies long, hot boolean, around binary"), "suffix-around")
    dense = around.where("NOT hot").repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_dense, _PLACES)
    # A suffix with very many different surroundings: one row a string, by hash, so that no task gets the group.
    strings = around.where("hot").dropDuplicates(["h", "f"]).select("h", "f", "copies", F.posexplode(F.transform(F.sequence(F.lit(0).cast("int"), (F.col("n") - 1).cast("int")), lambda i: F.md5(F.col("around").substr(i + 1, F.lit(MATCH))))).alias("k", "digest"))
    known = strings.groupBy("digest").agg(F.sum("copies").alias("times")).where("times > 1")
    hot = strings.join(known, "digest", "left_semi").select("h", "f", F.array(F.col("k").cast("long")).alias("first"), F.array(F.col("k").cast("long")).alias("last"))
    places = dense.unionByName(hot)
    spans = unlike.select("h", "f", "doc_id", "text_key", "start").join(places, ["h", "f"]).select("doc_id", "text_key", "start", F.explode(F.arrays_zip("first", "last")).alias("p"))
    spans = spans.select("doc_id", "text_key", (F.col("start") + F.col("p.first")).alias("first"), (F.col("start") + F.col("p.last") + MATCH).alias("last"))
    return alike.unionByName(spans)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def remove_repeats(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left (binary) of each text's UTF-8 bytes without those in a MATCH-byte string that starts anywhere else, in the text or another.

    Strings are judged on the input and never cross documents. Null texts are empty. Repeated rows of a doc_id are
    documents of their own; equal ones get equal results.
    """
    docs = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(docs, batches).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = docs.join(spans.toDF("d", "k", "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "spans")
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(b"").alias("kept")).schema

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, spans_of in zip(part.column("text"), part.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                left, end, removed, n = [], 0, 0, 0
                if spans_of.is_valid:
                    s = spans_of.values
                    pairs = np.stack([np.asarray(s.field("first")), np.asarray(s.field("last"))], axis=1)
                    reached = -1
                    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                        if a > reached:
                            n += 1
                            left.append(raw[end:a])
                            removed += b - a
                            end = reached = b
                        elif b > reached:
                            removed += b - reached
                            end = reached = b
                out.append((len(raw), removed, n, b"".join([*left, raw[end:]])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], names=schema.fieldNames())

    return joined.mapInArrow(kept, schema)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
