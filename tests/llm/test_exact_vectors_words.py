"""Hard negatives, whitening and repeated word windows against brute force, on real rows and tricky ones."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loamgrid.llm import negatives, registry, trees, whitening


def rows_of(spark, d, name):
    return [r.asDict() for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]


@pytest.mark.parametrize(("size", "dim"), [(150, 64), (1e6, 3000), (1e9, 5), (1e40, 7), (0, 4)])
def test_residue_scores_are_exact(size, dim):
    rng = np.random.default_rng(dim)
    a, b = (np.floor(rng.standard_normal((k, dim)) * size) for k in (9, 7))
    want = [[max(-negatives.LONG, min(negatives.LONG, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in b] for r in a]
    assert (negatives.exact_scores(a, b) == np.array(want, object)).all()
    primes = negatives.primes_for(dim * int(abs(a).max()) * int(abs(b).max()))
    assert len(primes) >= 3 and all(p < 256 for p in primes) and len(set(primes)) == len(primes)


def mined(rows):
    """Hard negatives by the rule, row by row."""
    usable = []
    for r in rows:
        v = r["embedding"]
        if r["label"] is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] is not None and r["vec_id"] % 7 == 0 else r["label"]
        usable.append((r["vec_id"], label, [math.floor(256 * float(c)) for c in v]))
    out = Counter()
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, (vec_id, label, x) in enumerate(usable):
        if vec_id is None or vec_id % 50:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=True))
        others = [(o, la, score(y)) for j, (o, la, y) in enumerate(usable) if j != i and len(y) == len(x)]
        for positive, p in sorted(((o, s) for o, la, s in others if la == label), key=order)[:5]:
            fits = sorted(((o, s) for o, la, s in others if la != label and 50 * p <= 100 * s <= 95 * p), key=order)[:3]
            for rank, (o, s) in enumerate(fits, 1):
                out[(vec_id, positive, rank, o, p, s)] += 1
    return out


@pytest.mark.parametrize("tile", [negatives.TILE, 7])
def test_op11_ties_nulls_and_copies(spark, tile):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 4, 3) / 4], int(rng.integers(0, 3))) for k in range(0, 260, 2)]
    rows += [rows[0], rows[0], rows[25], rows[30], (50, [3.0e38, 1.0, -2.0e38], 1), (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.25], 2), (100, None, 1), (150, [1.0, None, 1.0], 1), (150, [1.0, float("nan"), 1.0], 1)]
    rows += [(150, [1.0, 2.0, 3.0], None), (200, [1.0], 4), (201, [2.0], 4), (203, [1.5], 5), (250, [], 1), (251, [], 1), (253, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    small = [r.asDict() for r in table.where("NOT exists(embedding, c -> abs(c) > 1e30)").collect()]
    got = negatives.hard_negatives(table.where("coalesce(NOT exists(embedding, c -> abs(c) > 1e30), true)").selectExpr("*", "1 AS x", "2 AS row", "3 AS rank"), tile)
    assert Counter(map(tuple, got.collect())) == mined(small)
    huge = negatives.hard_negatives(table, tile).where("anchor_id = 50 AND abs(positive_score) > 1000000").collect()
    assert all(50 * r.positive_score <= 100 * r.negative_score <= 95 * r.positive_score for r in huge)


def test_op11_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = registry.QUERIES["op11_hard_negatives"](spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(registry.SQL["op11_hard_negatives"]).fetchall()) != []


def cases():
    rng = np.random.default_rng(3)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    of = lambda e: (q := turn(len(e))) @ np.diag(np.array(e, float)) @ q.T
    noise = rng.standard_normal((300, 64)) * 5
    return {"noise": np.cov(noise.T), "few": np.cov(noise[:10].T), "graded": of(np.logspace(3, -6, 50)), "equal": of([3] * 40), "steps": of(range(1, 101)), "ties": of([5, 5, 5, 1, 1, 0, 0]), "cluster": of([10] * 33 + [1] * 47), "one": np.array([[2.0]]), "zero": np.zeros((4, 4)), "none": np.zeros((0, 0))}


@pytest.mark.parametrize("name", cases())
def test_contour_components(name):
    v = cases()[name]
    v = (v + v.T) / 2
    e, x = whitening.largest_components(v)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:32] if len(v) else np.zeros(0)
    want = want[want > 1e-12 * max(want, default=0)]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-5) and np.allclose(x @ x.T, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ x.T - x.T * e).max(initial=0) <= 1e-12 * max(np.abs(v).max(initial=0), 1e-300)


def test_inertia_counts():
    v = cases()["noise"]
    d, off = whitening.tridiagonal(v)
    e = np.linalg.eigvalsh(v)
    assert all(whitening.count_above(d, off, s) == (e > s).sum() for s in np.linspace(e[0] - 1, e[-1] + 1, 50))
    parts = whitening.intervals(d, off, 32, 1e-9)
    assert all(((e > low) & (e <= high)).sum() == n for low, high, n in parts) and sum(n for *_, n in parts) >= 32


def crowded():
    """Spectra whose values crowd below a few large ones (as with many copies of one vector), or are equal far beyond the 32nd."""
    rng = np.random.default_rng(4)

    def of(e):
        q = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
        return q @ np.diag(np.array(e, float)) @ q.T

    return {"spike": of([400, 130, *np.linspace(69, 48, 62)]), "narrow": of([1000, *np.linspace(101, 100, 127)]), "equal": of([3] * 100), "one-hot": np.eye(128) / 128 - 1 / 128**2, "dense": of(np.linspace(1, 1 + 1e-4, 90)), "near": of(1 + 1e-10 * np.arange(90)), "two": of([7] * 20 + [6.999999] * 30 + [1] * 50)}


@pytest.mark.parametrize("name", crowded())
def test_crowded_components(name):
    v = crowded()[name]
    v = (v + v.T) / 2
    e, x = whitening.largest_components(v)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(v))[::-1][:32], rtol=1e-12) and np.allclose(x @ x.T, np.eye(32), atol=1e-12)
    assert np.abs(v @ x.T - x.T * e).max() <= 1e-12 * np.abs(v).max()


def test_op12_one_hot(spark):
    """All directions but one have the same variance: any 32 of them do."""
    table = spark.createDataFrame([(i, [float(i == k) for k in range(100)]) for i in range(100)], "vec_id long, embedding array<float>")
    got = whitening.whitened(table).toPandas()
    assert len(got) == 3200 and got.identity_error.max() <= 1e-9 and np.allclose(got.explained, 1 / 99)


def test_op12_rows(spark, sf):
    got = registry.QUERIES["op12_whitening"](spark, sf).toPandas()
    r = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(r.embedding).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.iloc[0] <= 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[r.vec_id].to_numpy()
    want = (x - x.mean(axis=0)) @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-8
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[r.vec_id].to_numpy() == ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).all()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e[:32] / e.sum())


def test_op12_tricky(spark, tricky):
    got = registry.QUERIES["op12_whitening"](spark, tricky).toPandas()
    good = [r for r in rows_of(spark, tricky, "embeddings") if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    four = [r for r in good if len(r["embedding"]) == 4]
    y = np.floor(64 * np.array([r["embedding"] for r in four]))
    e = np.linalg.eigvalsh(np.cov(y.T, bias=True))
    k = int((e > 1e-9).sum())
    # The two equal vectors of length 2 and the empty one have no variance, and so no component.
    assert Counter(got.vec_id.isna()) == {False: k * (len(four) - 1), True: k} and set(got.n) == {len(four)} and sorted(set(got.component)) == list(range(1, k + 1))
    dev = ((len(y) * y - y.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(got[got.component == 1].deviation) == sorted(dev.astype(int))
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    huge = whitening.whitened(table).collect()
    assert len(huge) >= 3 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_op12_merges(spark):
    """Moments in many parts and steps equal those at once."""
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 50, (700, 5)).astype(float)
    table = spark.createDataFrame([(5, [float(c) for c in row]) for row in m], "dim int, y array<double>").repartition(90)
    (r,) = whitening.moments(table, lambda dim, y: y).collect()
    assert r.n == 700 and [h * 2**26 + low for h, low in zip(r.high, r.low, strict=True)] == m.sum(axis=0).astype(int).tolist()
    assert np.allclose(np.array(r.scatter).reshape(5, 5) / 700, np.cov(m.T, bias=True))


def unrepeated(rows):
    """(n_words, n_removed, kept_sha256) by document, window by window."""
    key = lambda t: -1 if t is None else t
    first, texts = {}, {}
    for d, t, h in rows:
        texts[(d is None, key(d), h)] = (d, t)
    out = Counter()
    told = {}
    for order in sorted(texts):
        w = (texts[order][1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in first:
                gone[i : i + 20] = True
            first.setdefault(k, order)
        told[order] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    for d, _, h in rows:
        out[(d, *told[(d is None, key(d), h)])] += 1
    return out


@pytest.mark.parametrize("group", [trees.GROUP, 2])
def test_op13_all_windows(spark, tricky, monkeypatch, group):
    """Groups of any size: with a limit of two, most go through longer prefixes."""
    monkeypatch.setattr(trees, "GROUP", group)
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    rng = np.random.default_rng(8)
    words = [f"v{k}" for k in rng.integers(0, 40, 400)]
    more = [(20_000 + k, " ".join(words[a : a + 90]) + f" end{k} " + " ".join(words[b : b + 40])) for k, (a, b) in enumerate(rng.integers(0, 300, (60, 2)).tolist())]
    more += [(21_000, "x " * 500), (21_001, " ".join(["x"] * 21)), (21_002, " ".join(words)), (21_003, "\t".join(words) + "\n"), (None, " ".join(words)), (None, " ".join(words)), (20_000, " ".join(words[:50]))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 AS h", "2 AS start", "'x' AS text_key")
    want = unrepeated([tuple(r) for r in table.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()])
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in trees.remove_repeats(table).collect())
    assert got == want and sum(r[2] > 0 for r in want) > 50


def test_op13_pieces(monkeypatch):
    """A very long text in pieces has the same windows, each once, with very long words by digest."""
    monkeypatch.setattr(trees, "PIECE", 300)
    monkeypatch.setattr(trees, "LONG_WORD", 30)
    rng = np.random.default_rng(2)
    raw = " \n".join("ab" * int(k) + str(k) for k in rng.integers(0, 40, 900)).encode()
    whole = raw.split()
    seen = defaultdict(int)
    for first, piece in trees.pieces(raw):
        w = piece.split()
        codes, _ = trees.word_codes(piece)
        assert len(codes) == len(w) and all(a == b or (a[:1] == b"\xff" and len(b) > 30) for a, b in zip(w, whole[first:], strict=False))
        for k in range(len(w) - 19):
            seen[first + k] += 1
    assert seen == {k: 1 for k in range(len(whole) - 19)}


def test_op13_deep_nodes():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2, 300).astype(np.uint64)
    codes[100:160] = codes[10:70]
    at = np.arange(281)
    node = trees.deep_nodes(codes, at)
    words = [tuple(codes[k : k + 20]) for k in at]
    assert all((node[i] == node[j]) == (words[i] == words[j]) for i in range(0, 281, 3) for j in range(281))
