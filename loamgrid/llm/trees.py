"""Removal of long repeated word sequences with suffix trees that are partitioned by variable-length prefixes.

A suffix for each word of a corpus would exceed any disk, so the trees are sparse: of each window of WINDOW words the
suffix whose first PREFIX words hash lowest is in, and two equal windows always share one. These prefixes split the
suffixes into groups, of which those with one suffix, or with equal surroundings only, need no tree. A group with more
different surroundings than a task should hold is split again, its windows by their first 9, 12, 16, 20 words, until each
part fits. Each group's subtree is built to depth WINDOW; its internal nodes there are the repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, read, staged

WINDOW, PREFIX = 20, 6
#: Lengths in words of the longer prefixes, and different surroundings beyond which a group is split by the next one.
LONGER, GROUP = (9, 12, 16), 8192
#: Bytes of text whose suffixes are sampled together, a piece of a longer text; words of surroundings in one subtree block.
PIECE, TREE_BLOCK = 1 << 20, 1 << 18
#: Words of more bytes count by their digest, behind a byte that UTF-8 does not have.
LONG_WORD = 1 << 12
_PLACE = np.uint64((1 << 22) - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _stretches(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the stretches [first, last) of values, mixed; base is odd."""
    size = 1 << max(1, len(values)).bit_length()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, size)[: len(values)])))
    return _mixed((sums[last] - sums[first]) * _powers(pow(base, -1, 1 << 64), size)[first])


def word_codes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word of a block, and where the word begins."""
    b = np.frombuffer(block, np.uint8)
    inside = np.concatenate(([False], (b != 32) & ((b < 9) | (b > 13)), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    return _stretches(b.astype(np.uint64) + np.uint64(1), first, last, 0x9E3779B97F4A7C15), first


def pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(number of its first word, text) of pieces of a text, of about PIECE bytes; each begins with the last WINDOW - 1 words of the one before, so that no window is lost or found twice."""
    at, first, carried = 0, 0, []
    while True:
        end = at + PIECE
        cut = _SPACE.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = carried + raw[at:end].split()
        yield first, b" ".join(w if len(w) <= LONG_WORD else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in words)
        if end >= len(raw):
            return
        carried = words[1 - WINDOW :]
        first += len(words) - len(carried)
        at = end


def sampled(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, prefix hash, surroundings hash) of the runs of windows that share a sampled suffix.

    codes: words of texts on end, ends: where each text ends. A run is ``count`` windows at consecutive words from
    ``first`` on, inside one text; its surroundings are the words that they cover.
    """
    n = len(codes)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    places = np.arange(n - PREFIX + 1)
    prefix = _stretches(codes, places, places + PREFIX, 0xC2B2AE3D27D4EB4F)
    low = (prefix & ~_PLACE) | places.astype(np.uint64)
    width, want, windows = 1, WINDOW - PREFIX + 1, n - WINDOW + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:windows], low[want - width : want - width + windows])
    at = (low & _PLACE).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, np.int64)  # windows that end in the text in which they start
    long = ends - starts >= WINDOW
    inside[starts[long]] += 1
    inside[ends[long] - WINDOW + 1] -= 1
    good = np.cumsum(inside)[:windows] > 0
    new = good.copy()
    new[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    count = np.add.reduceat(good, first, dtype=np.int64)
    around = _stretches(codes, first, first + count - 1 + WINDOW, 0x165667B19E3779F9) ^ _mixed(count.astype(np.uint64))
    return first, count, prefix[at[first]].view(np.int64), around.view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """(h, f, doc_id, text_key, start, n) for the runs of each whole text: hash of the sampled suffix's prefix, hash of the surroundings, first word, number of windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column("doc_id"), batch.column("text_key")
            texts: list[bytes] = []
            index: list[int] = []
            offset: list[int] = []

            def flush() -> pa.RecordBatch:
                codes, at = word_codes(b" ".join(texts))
                ends = np.searchsorted(at, np.cumsum([len(x) + 1 for x in texts]))
                first, n, h, f = sampled(codes, ends)
                part = np.searchsorted(ends, first, side="right")
                start = first - np.concatenate(([0], ends[:-1]))[part] + np.array(offset, np.int64)[part]
                row = pa.array(np.array(index, np.int64)[part])
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), doc.take(row), key.take(row), pa.array(start), pa.array(n)], names=["h", "f", "doc_id", "text_key", "start", "n"])

            size = 0
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                for first, piece in pieces(raw) if len(raw) > LONG_WORD * 4 else [(0, raw)]:
                    texts.append(piece)
                    index.append(i)
                    offset.append(first)
                    size += len(piece)
                    if size >= PIECE:
                        yield flush()
                        texts, index, offset, size = [], [], [], 0
            if texts:
                yield flush()

    long = F.lit(0).cast("long")
    schema = docs.select(long.alias("h"), long.alias("f"), "doc_id", "text_key", long.alias("start"), long.alias("n")).schema
    return docs.select("doc_id", "text_key", "text").mapInArrow(found, schema)


#: A member of a group: a surroundings (h, f), its first occurrence, and its windows from k on, whose words have codes.
_MEMBER = "part long, h long, f long, k int, n int, no_id boolean, doc_id long, text_key long, start long, codes array<long>"


def deep_nodes(codes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The node of depth WINDOW in the suffix tree of codes, for each of the suffixes that begin at ``suffix``.

    The suffixes are ordered by prefix doubling (ranks at depth 1, 2, 4, 8, 16); two that stand next to each other with a
    common prefix of WINDOW words are leaves below one node, an internal one if it has two leaves or more.
    """

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1]))).astype(np.uint64)
        return rank

    rank, depth = ranked(codes), 1
    while depth * 2 <= WINDOW:
        after = np.zeros(len(codes), np.uint64)
        after[:-depth] = rank[depth:]
        rank, depth = ranked(rank << np.uint64(32) | after), depth * 2
    return ranked(rank[suffix] << np.uint64(32) | rank[suffix + WINDOW - depth]).astype(np.int64)


def _subtree(members: pa.Table) -> pa.Table:
    """(h, f, gone): windows of members that occur earlier, in another member's first occurrence. members: whole groups."""
    n, k = (np.asarray(members.column(c)).astype(np.int64) for c in ("n", "k"))
    codes = members.column("codes").combine_chunks()
    begin = np.asarray(codes.offsets)[:-1].astype(np.int64) - codes.offsets[0].as_py()
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # Groups are told apart at the root: equal windows of two groups are one node, which changes nothing.
    node = deep_nodes(np.asarray(codes.flatten()).view(np.uint64), begin[row] + inside)
    place = np.asarray(members.column("start"))[row] + k[row] + inside
    doc = np.asarray(members.column("doc_id").combine_chunks().fill_null(0))
    order = np.lexsort((place, np.asarray(members.column("text_key"))[row], doc[row], np.asarray(members.column("no_id"))[row], node))
    first = np.ones(len(order), bool)
    first[1:] = node[order][1:] != node[order][:-1]
    gone = order[~first]
    gone = gone[np.argsort(row[gone], kind="stable")]
    return pa.table([members.column("h").take(pa.array(row[gone])), members.column("f").take(pa.array(row[gone])), pa.array((k[row] + inside)[gone].astype(np.int32))], names=["h", "f", "k"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members come sorted by group; a block of whole groups shares one tree."""
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        part = np.asarray(batch.column("part"))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        sizes = np.asarray(batch.column("codes").offsets)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and words >= TREE_BLOCK and held[-1].column("part")[-1].as_py() != part[a]:
                yield from _subtree(pa.Table.from_batches(held)).to_batches()
                held, words = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                words += int(sizes[b] - sizes[a])
    if held:
        yield from _subtree(pa.Table.from_batches(held)).to_batches()


def grown(members: DataFrame) -> DataFrame:
    """(h, f, k) of windows that occur earlier, from the subtrees of groups of members (_MEMBER), each of which a task holds whole."""
    rows = members.repartition(partitions(members.sparkSession), "part").sortWithinPartitions("part")
    return rows.mapInArrow(_subtrees, "h long, f long, k int")


def split_further(members: DataFrame) -> DataFrame:
    """As grown, for members of groups that are too large: their windows are split by longer and longer prefixes."""
    window = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    rest = members.select("h", "f", "no_id", "doc_id", "text_key", "start", "codes", window)
    rest = rest.select(F.col("h").alias("part"), "h", "f", F.col("i").alias("k"), F.lit(1).alias("n"), "no_id", "doc_id", "text_key", "start", F.slice("codes", F.col("i") + 1, WINDOW).alias("codes"))
    found = None
    for length in LONGER:
        rest = staged(rest.withColumn("part", F.xxhash64(F.lit(length), F.slice("codes", 1, length))), "tree-windows")
        size = staged(rest.groupBy("part").agg(F.count("*").alias("size")).where("size > 1"), "tree-sizes")
        small = grown(rest.join(size.where(F.col("size") <= GROUP), "part", "left_semi"))
        found = small if found is None else found.unionByName(small)
        rest = rest.join(size.where(F.col("size") > GROUP), "part", "left_semi")
    # Of equal whole windows, however many, the earliest is told by an aggregate.
    at = F.struct("no_id", "doc_id", "text_key", (F.col("start") + F.col("k")).alias("place"))
    rest = staged(rest.select("h", "f", "k", F.xxhash64("codes").alias("w1"), F.xxhash64(F.lit(1), "codes").alias("w2"), at.alias("at")), "tree-windows")
    least = rest.groupBy("w1", "w2").agg(F.min("at").alias("least"))
    return found.unionByName(rest.join(least, ["w1", "w2"]).where(~F.col("at").eqNullSafe(F.col("least"))).select("h", "f", "k"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, last): spans of words [first, last) of docs (doc_id, text_key, text) whose windows all start earlier, too."""
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start")
    runs = staged(suffixes(docs), "tree-runs")
    # Prefixes of more than one suffix; staged, so that the join reads two shuffles and a hot prefix can be split.
    often = staged(runs.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h"), "tree-prefixes")
    shared = staged(runs.join(often, "h"), "tree-shared")
    discard(runs, often)
    members = staged(shared.groupBy("h", "f").agg(F.min(at).alias("at"), F.min("n").cast("int").alias("n"), F.count("*").alias("copies")), "tree-members")
    kinds = staged(members.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "tree-kinds")
    # All but the first of equal surroundings go whole.
    again = shared.join(members.where("copies > 1").select("h", "f", F.col("at").alias("least")), ["h", "f"]).where(~at.eqNullSafe(F.col("least")))
    again = staged(again.select("doc_id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1 + WINDOW).alias("last")), "tree-spans")
    # First occurrences of surroundings that share a prefix, but differ, go to their texts for the words.
    unlike = members.join(kinds, "h").select("h", "f", "n", F.col("kinds").alias("kinds"), "at.*")
    wanted = unlike.groupBy("no_id", "doc_id", "text_key").agg(F.collect_list(F.struct("h", "f", "n", "kinds", "start")).alias("members"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "members")
    held = docs.select("doc_id", "text_key", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    held = held.select("doc_id", "text_key", "text", "members")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, members_of in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text"), batch.column("members"), strict=True):
                of = members_of.values
                h, f, n, kinds, start = (np.asarray(of.field(c)) for c in ("h", "f", "n", "kinds", "start"))
                order, done = np.argsort(start), 0
                raw = text.as_py().encode()
                for first, piece in pieces(raw):
                    codes, _ = word_codes(piece)
                    until = done
                    while until < len(order) and start[order[until]] + n[order[until]] - 1 + WINDOW <= first + len(codes):
                        until += 1
                    mine, done = order[done:until], until
                    if len(mine):
                        many = [codes[s - first : s - first + m - 1 + WINDOW].view(np.int64) for s, m in zip(start[mine].tolist(), n[mine].tolist(), strict=True)]
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in many]))), pa.int32()), pa.array(np.concatenate(many)))
                        same = len(mine)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[mine]), pa.array(h[mine]), pa.array(f[mine]), pa.array(np.zeros(same, np.int32)), pa.array(n[mine].astype(np.int32)), pa.array([doc is None] * same), pa.array([doc] * same, pa.int64()), pa.array([key] * same, pa.int64()), pa.array(start[mine]), lists, pa.array(kinds[mine])],
                            names=["part", "h", "f", "k", "n", "no_id", "doc_id", "text_key", "start", "codes", "kinds"],
                        )

    # Equal rows of a document give equal members.
    words = staged(held.dropDuplicates(["doc_id", "text_key"]).mapInArrow(cut, _MEMBER + ", kinds long"), "tree-words")
    gone = grown(words.where(F.col("kinds") <= GROUP).drop("kinds")).unionByName(split_further(words.where(F.col("kinds") > GROUP)))
    gone = gone.distinct().join(members.select("h", "f", "at.doc_id", "at.text_key", "at.start"), ["h", "f"])
    first = F.col("start") + F.col("k")
    return again.unionByName(gone.select("doc_id", "text_key", first.alias("first"), (first + WINDOW).alias("last")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of each text's words, by one space each, without those in a window of WINDOW words whose words also start earlier.

    Earlier is a smaller doc_id (none comes last), among texts of one doc_id a smaller hash of the text, and in a text a
    smaller word number. Windows are judged on the input and never cross documents. Null and empty texts have no words.
    Equal rows of a doc_id are one document and get equal results. Very long texts are read in pieces. Other columns are
    left out; an empty table stays empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(docs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = docs.join(spans.toDF("d", "k", "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "spans")
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(b"").alias("kept")).schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_of in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if spans_of.is_valid:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, np.asarray(spans_of.values.field("first")), 1)
                    np.add.at(edges, np.asarray(spans_of.values.field("last")), -1)
                    stays = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                    words = [words[i] for i in stays.tolist()]
                out.append((n, n - len(words), b" ".join(words)))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.fieldNames())

    return joined.mapInArrow(kept, schema)


def op13_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
