"""Quality rules on repetition inside a text, by suffix arrays of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, read

SYMBOLS = "#*$%&|<>"
#: Repeats shorter than this many words are left out of the suffix-array verdict.
MIN_REPEAT = 8
#: Most share of words that may lie in repeats, and most words of one repeat as a share of the text and at all.
MAX_COVERED = 0.4
MAX_LONGEST_SHARE = 0.34
MAX_LONGEST = 1000
#: Words whose suffix arrays are built together in one task.
BLOCK_WORDS = 200_000

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each suffix of ids, the longest prefix that it shares with any other suffix.

    The suffix array comes by prefix doubling; the ranks of every step are kept, and the common prefixes of neighbours
    in the array are found from them, largest step first. A suffix's longest repeat is that with one of its neighbours.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if new[order[-1]] == n - 1:
            break
        ranks.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[j][x[inside]] == ranks[j][y[inside]]
        shared += same.astype(np.int64) << j
    best = np.zeros(n, np.int64)
    best[a] = shared
    best[b] = np.maximum(best[b], shared)
    return best


def repetition(words_of: list[list[bytes]], min_repeat: int) -> list[tuple[int, int, int]]:
    """(repeat words by 3-word windows, words covered by repeats, longest repeat) of each text."""
    n = np.array([len(w) for w in words_of], np.int64)
    total, start = int(n.sum()), np.concatenate(([0], np.cumsum(n)[:-1]))
    code: dict[bytes, int] = {}
    word = np.fromiter((code.setdefault(w, len(code)) for words in words_of for w in words), np.int64, total)
    doc = np.repeat(np.arange(len(n)), n)
    ids = doc * (len(code) + 1) + word  # a word of another text is another word, so no repeat crosses texts
    best = longest_repeats(ids)

    def covered(length: np.ndarray) -> np.ndarray:
        edge = np.zeros(total + 1, np.int64)
        at = np.flatnonzero(length)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length[at], -1)
        return np.cumsum(edge[:total]) > 0

    in_window = covered(np.where(best >= 3, 3, 0))
    in_repeat = covered(np.where(best >= min_repeat, best, 0))
    per = lambda x, f: [int(f(x[s : s + k])) if k else 0 for s, k in zip(start, n, strict=True)]
    return list(zip(per(in_window, np.sum), per(in_repeat, np.sum), per(best, np.max), strict=True))


def judge(texts: list[str | None], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest_share: float = MAX_LONGEST_SHARE, max_longest: int = MAX_LONGEST) -> list[dict]:
    """The columns of VERDICT for each text."""
    out: list[dict] = []
    block: list[tuple[str, bytes, list[bytes]]] = []
    size = 0

    def flush() -> None:
        found = repetition([words for _, _, words in block], min_repeat)
        for (t, raw, words), (windows, covered, longest) in zip(block, found, strict=True):
            n = len(words)
            lines = [x for x in raw.split(b"\n") if x.split()]
            base = n < 50 or 100 * windows > 50 * n
            repeats = longest >= min_repeat and (longest > max_longest or longest > max_longest_share * n)
            out.append({
                "n_words": n, "word_chars": len(t) - sum(map(t.count, SPACE_CHARS)), "n_symbols": sum(map(t.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": windows,
                "base_failed": base, "covered_words": covered, "longest_repeat": longest, "kept": not (base or covered > max_covered * n or repeats),
            })

    for t in texts:  # many short texts share a suffix array, a long one has its own; the words of one block are held at a time
        raw = (t or "").encode()
        words = raw.split()
        if block and size + len(words) > BLOCK_WORDS:
            flush()
            block, size = [], 0
        block.append((t or "", raw, words))
        size += len(words)
    if block:
        flush()
    return out


def quality_verdicts(docs: DataFrame, prefix: str = "", **limits) -> DataFrame:
    """docs with the columns of VERDICT, named with prefix.

    Null and empty texts have no words and fail. Each row is judged alone, so ties and repeated rows get the same
    verdict and extra columns pass through; columns of docs named as added ones are replaced.
    """
    schema = docs.schema
    added = [x.split() for x in VERDICT.split(", ")]
    names = [f"{prefix}{n}" for n, _ in added]
    keep = [f for f in schema.fieldNames() if f not in names]
    out_schema = docs.select(*keep).schema
    for (_, kind), name in zip(added, names, strict=True):
        out_schema = out_schema.add(name, kind)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(batch.column("text").to_pylist(), **limits)
            new = [pa.array([r[n] for r in rows], pa.bool_() if kind == "boolean" else pa.int64()) for n, kind in added]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + new, names=keep + names)

    return docs.mapInArrow(judged, out_schema)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return quality_verdicts(docs, "__q_", **limits).where("__q_kept").select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_verdicts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *[x.split()[0] for x in VERDICT.split(", ")])
