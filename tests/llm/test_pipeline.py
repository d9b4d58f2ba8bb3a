"""The pipeline's stages, each against what its own operator says of its input."""

from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from loamgrid.llm import mixing, quality
from loamgrid.llm.common import staged, word_count

from test_near import roots


def test_stages(spark, tricky):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{tricky}/documents.parquet").select(*columns)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, tricky), "stage")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = spark.read.parquet(f"{tricky}/documents.parquet").select("doc_id", "text").collect()
    kept = [r.doc_id for r, v in zip(first, quality.judge([r.text for r in first]), strict=True) if v["kept"]]
    assert sorted(r.doc_id for r in seen["quality rules"].collect()) == sorted(kept) and kept
    assert seen["line dedup"].count() == len(kept)
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"].collect())
    once = [r.doc_id for r in seen["simhash near-dedup"].collect()]
    assert len(once) == len(set(once)) and set(once) <= set(kept)
    mixed = seen["mixing sources"].collect()
    assert {r.doc_id for r in mixed} <= set(once) and max(sum(r.doc_id == i for r in mixed) for i in once) <= 2
    packed = seen["best-fit packing"].toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and (packed.piece == 0).sum() == len(mixed)


def plain_lines(rows):
    """Texts without lines similar to an earlier one, rows equal in doc_id and text counting once."""
    key = lambda t: int(np.array([xxhash.xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0])
    seen, kept = [], {}
    for doc_id, text in sorted({(r.doc_id, r.text) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, key(d[1]))):
        left = []
        for line in (text or "").split("\n"):
            w = set(line.encode().split())
            if not w or not any(9 * len(w & o) >= 4 * (len(w) + len(o)) for o in seen if 0.8 * len(o) <= len(w) <= 1.25 * len(o)):
                left.append(line)
            if w:
                seen.append(w)
        kept[doc_id, text] = None if text is None else "\n".join(left)
    return Counter((r.doc_id, kept[r.doc_id, r.text]) for r in rows)


def test_contents_of_stages(spark, tricky):
    """What the middle stages keep, by plain versions of their rules, on rows with copies, shared lines and missing ids."""
    docs = spark.read.parquet(f"{tricky}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.collect()
    lines = staged(corpus_pipeline.line_dedup(spark, docs, tricky), "stage")
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == plain_lines(rows)
    words = [tuple((r.text or "").encode().lower().split()) for r in rows]
    sets = [frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    root = roots(sets)
    once = staged(corpus_pipeline.near_dedup(spark, docs, tricky), "stage")
    first = {}
    for r, k in zip(rows, root, strict=True):
        if k not in first or (r.doc_id is None, r.doc_id or 0) < first[k]:
            first[k] = (r.doc_id is None, r.doc_id or 0)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == Counter(first.values())
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, once, tricky).collect())
    taken = mixing.with_copies(once).collect()
    assert mixed == Counter({(r.doc_id, r.text): r["__copies"] for r in taken if r["__copies"]})
    for r in {r.source: r for r in taken if r["__source_size"] > 5000}.values():
        got = sum(x["__size"] * x["__copies"] for x in taken if x.source == r.source)
        assert abs(got - r["__target"]) <= max(x["__size"] for x in taken if x.source == r.source)


def test_run_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\n", "a\x0bb\x0cc\r", " x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(df.text)).collect()] == [len((t or "").encode().split()) for t in texts]
