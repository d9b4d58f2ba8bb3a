"""Best-fit packing of tokenized documents by patterns: non-negative least squares on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

TOKENIZER = "byte_bpe_50k"
#: A text's end: the id that follows its ids. Fixed by the contract.
END_ID = 2
LENGTH = 1024
#: Shares of the fitted repeats that a plan tries; that with the fewest sequences is taken.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
#: The special token that the tokenizer finds in texts, and its id.
SPECIAL = ("<|endoftext|>", 50256)


class Tokenizer:
    """The byte-level BPE of ``<name>.json``.

    The same vocabulary as ranks encodes several times as fast, and ids come as one array; the tests hold it against
    the ``tokenizers`` library on the same file. The folder of the files is a parameter; None asks the installed
    package. What the ranks' library can't do (it refuses texts with about a million blanks in a row) goes to
    ``tokenizers``.
    """

    def __init__(self, name: str = TOKENIZER, folder: str | None = None) -> None:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = os.path.join(folder, f"{name}.tiktoken") if folder else public_tokenizers.path(f"{name}.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL[0]: SPECIAL[1]})
        self._json = os.path.join(folder, f"{name}.json") if folder else public_tokenizers.path(f"{name}.json")
        self._slow = None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._bpe.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # "Max stack size exceeded" in its regex
            return self._whole(text)

    def _whole(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer as Json

            self._slow = Json.from_file(self._json)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(*key) -> Tokenizer:
    """One for each worker process."""
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(*key)
    return _tokenizers[key]


def pieces(docs: DataFrame, length: int = LENGTH, name: str = TOKENIZER, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and END_ID, cut into pieces only if longer than ``length``.

    All pieces but the first then have ``length`` ids. A null text is an empty one: END_ID alone.
    """
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", "binary") if with_ids else schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % length or min(len(ids), length)
                for p, start in enumerate([0, *range(first, len(ids), length)]):
                    one = ids[start : first if p == 0 else start + length]
                    at.append(k)
                    rows.append((p, start, len(one), zlib.crc32(one), *([one.tobytes()] if with_ids else [])))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 4 + with_ids])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *made], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of patterns (lengths in each) that bring sum of x times pattern near target, by cyclic coordinate descent on the squared error."""
    left, x = target.astype(float).copy(), np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    norms = [float((n * n).sum()) for _, n in parts]
    for _ in range(rounds):
        moved = 0.0
        for k, (at, n) in enumerate(parts):
            step = max(-x[k], float((left[at] * n).sum()) / norms[k])
            if step:
                x[k] += step
                left[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def patterns(counts: np.ndarray, length: int) -> list[tuple[int, ...]]:
    """Full sequences of one to three documents, from lengths that occur: pairs that fill it, and triples of a length, the half of the rest nearest below, and what fills it.

    At most two or three a length, so their number is bounded by the sequence length.
    """
    there = np.flatnonzero(counts)
    found = {(int(a), int(length - a)) for a in there if a < length and a <= length - a and counts[length - a]} | ({(length,)} if counts[length] else set())
    for a in there[there <= length // 3]:
        half = there[(there >= a) & (there <= (length - a) // 2)]
        for b in half[-2:]:
            c = length - int(a) - int(b)
            if c >= b and counts[c]:
                found.add((int(a), int(b), c))
    return sorted(found)


def best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): best-fit decreasing on a histogram. Sequences of equal content are one row with its number of repeats, so the work grows with the different lengths."""
    room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(free: int, content: tuple[int, ...], n: int) -> None:
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append([content, n])

    for size in range(length, 0, -1):
        n = int(counts[size])
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):  # open new ones, each with as many of this size as fit
                each = length // size
                if n >= each:
                    put(length - each * size, (size,) * each, n // each)
                if n % each:
                    put(length - (n % each) * size, (size,) * (n % each), 1)
                n = 0
                continue
            free = rooms[k]
            content, m = room[free].pop()
            if not room[free]:
                del room[free], rooms[k]
            each = min(free // size, n)
            use = min(m, n // each)
            if m > use:
                put(free, content, m - use)
            put(free - each * size, content + (size,) * each, use)
            n -= use * each
    return [(tuple(c), n) for kind in room.values() for c, n in kind]


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold each length of the histogram as often as it occurs.

    Patterns get a share of the repeats that NNLS fits, rounded down and never more than is left; the residual is packed
    best-fit. Of SHARES, that with the fewest sequences is taken, the largest of equals. Without patterns (no lengths fill
    a sequence together) and for an empty histogram all is residual.
    """
    found = patterns(counts, length)
    fitted = np.asarray(nnls(found, counts) if found else [])

    def with_share(share: float) -> list[tuple[tuple[int, ...], int]]:
        left, made = counts.copy(), []
        for k in np.argsort(-fitted, kind="stable"):
            at, n = np.unique(found[k], return_counts=True)
            use = int(min(np.floor(share * fitted[k] + 1e-9), (left[at] // n).min()))
            if use > 0:
                left[at] -= use * n
                made.append((found[k], use))
        return made + best_fit(left, length)

    return min(map(with_share, SHARES), key=lambda made: sum(n for _, n in made))


def slots(made: list[tuple[tuple[int, ...], int]], length: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): the pieces of that length from this rank on go to consecutive sequences at this offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks = np.zeros(length + 1, np.int64)
    sequence = 0
    for content, n in made:
        offset = 0
        for size in content:
            out.setdefault(size, []).append((int(ranks[size]), sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(docs: DataFrame, length: int = LENGTH, name: str = TOKENIZER, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all pieces of docs, in as few sequences as patterns and best fit find.

    The driver sees the histogram of lengths only (``length`` numbers). Pieces of a length are interchangeable, so each
    takes the slot of its rank within its length; ranks come from counts by (length, part) and places inside the part.
    Repeated rows are documents of their own; which of equally long pieces takes which slot is not fixed. Columns besides
    doc_id and text are left out, so their names can't clash. An empty table gives an empty result.
    """
    cut = pieces(docs, length, name, folder, with_ids)
    cut = staged(cut.withColumn("__part", F.spark_partition_id()), "pieces")
    counts = np.zeros(length + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``length`` rows
        counts[row["length"]] = row["n"]
    table = slots(plan(counts, length), length)
    by_part = cut.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    by_part = by_part.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    inside = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece"))
    ranked = cut.withColumn("__row", inside).join(by_part.drop("__n"), ["length", "__part"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row")
    columns = [c for c in cut.columns if c != "__part"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("__rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                at, rows = np.flatnonzero(size == n), table[int(n)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.select(*columns, "__rank").mapInArrow(placed, schema)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(read(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
