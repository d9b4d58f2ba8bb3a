"""The near-dedup stage against all pairs of texts."""

from collections import Counter

import numpy as np

import corpus_pipeline
from loamgrid.llm import near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def roots(sets):
    """For each set the first one that links of similarity 0.8 reach."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if root[i] != root[j] and (a == b or (a and b and both >= 0.8 * (len(a) + len(b) - both))):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted():
    """Texts of 300 words and copies with some words changed: similarities on both sides of 0.8, chains, and a large group."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for _ in range(2 if k % 3 else 1):
            for at in rng.choice(300, rng.integers(1, 9), replace=False):
                words[at] = f"n{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(words))
    words = [f"g{x}" for x in range(200)]
    for k in range(300):
        one = list(words)
        one[k % 200] = f"x{k}"
        one[(k * 7 + 3) % 200] = f"y{k}"
        texts.append(" ".join(one))
    return texts


def test_all_pairs(spark, tricky):
    real = [r.text for r in spark.read.parquet(f"{tricky}/documents.parquet").select("text").collect() if len(r.text or "") < 100_000]
    texts = planted() + real
    want = roots([shingles(t) for t in texts])
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, tricky).collect())
    assert got == sorted(set(want)) and len(texts) - len(got) > 500


def test_chunks(spark):
    """A band in several components is compared in pairs of chunks."""
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = near.sketches(docs).persist()
    node = {r.doc_id: r.node for r in rows.collect()}
    # One band for all: only the chunks can find the links that the smallest node has no part in.
    same = rows.withColumn("bands", near.F.array(near.F.lit(1).cast("long")))
    edges = [(r.a, r.b) for r in near.links(docs, same, chunk=64).collect()]
    root = {n: n for n in node.values()}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    want = roots([shingles(t) for t in texts])
    assert Counter(Counter(want).values()) == Counter(Counter(root[node[i]] for i in range(len(texts))).values())
    rows.unpersist()


def test_ids_missing_and_shared(spark, tricky):
    """Each group keeps exactly one row: different texts stay though their ids are null or the same."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(3)), (5, text(4)), (5, text(5)), (5, text(5)), (3, text(5)), (5, text(6)), (None, None), (None, ""), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, tricky).collect())
    assert got == Counter([(None, text(1)), (None, text(2)), (7, text(3)), (5, text(4)), (3, text(5)), (5, text(6)), (9, " ")])
