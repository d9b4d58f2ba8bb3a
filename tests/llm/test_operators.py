"""Each operator against a brute-force version, on real rows and tricky ones, and on empty tables."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql.functions import col

from loamgrid.llm import language, lines, mixing, packing, quality, registry, simhash, substrings, urls, vectors, warc


def table(spark, d, name):
    return [r.asDict() for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_op1_rules(spark, tricky):
    got = registry.QUERIES["op1_url_filter"](spark, tricky).collect()
    pages = table(spark, tricky, "pages")
    assert len(got) == len(pages)

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        k = min([rest.find(ch) for ch in "/?#" if ch in rest] or [len(rest)])
        tail = rest[k:]
        e = min([tail.find(ch) for ch in "?#" if ch in tail] or [len(tail)])
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), tail[:e]

    want = Counter()
    for p in pages:
        host, path = parts(p["url"])
        fits = [(r, v) for r, v in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=lambda x: len(x[0]))[0] if fits else None
        want[(p["page_id"], host, path, rule)] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    verdict = dict(urls.RULES)
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)


def test_op1_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(urls.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 5] > 0.3)).astype(float)
    assert ((urls.BoostedTrees(x[:1500], y[:1500]).probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


def test_op1_sample_takes_a_url_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(urls, "BoostedTrees", lambda x, y: seen.append(len(y)))
    rows = [("http://a.net/", "a.net", "/", "block")] * 50 + [(f"http://h{k}.org/fr/", f"h{k}.org", "/fr/", "allow") for k in range(5)]
    table = urls.with_statistics(spark.createDataFrame(rows, "url string, __host string, __path string, __label string"))
    urls.fit(table, 6)
    urls.fit(table, 3)
    assert seen == [6, 3]


def test_op1_held_out_urls(spark):
    """Labelled URLs whose label is hidden, by area under the curve, where the label follows the URL's form; statistics never see a row's own label."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(1200):
        block = k % 2 == 0
        suffix = rng.choice(["net", "org", "com"], p=[0.6, 0.3, 0.1] if block else [0.2, 0.4, 0.4])
        path = "/".join("".join(rng.choice(list("0123456789" if block and rng.random() < 0.5 else "abcdefg"), 4)) for _ in range(rng.integers(1, 6 if block else 4)))
        rows.append((f"http://h{k}.{suffix}/{path}" + "?a=1&b=2" * int(block and rng.random() < 0.4), f"h{k}.{suffix}", f"/{path}", "block" if block else "allow", k % 3 > 0))
    table = spark.createDataFrame(rows, "url string, __host string, __path string, truth string, shown boolean").selectExpr("*", "if(shown, truth, null) AS __label")
    told = urls.with_statistics(table)
    held = told.where("NOT shown").toArrow()
    p, y = urls.fit(told).probability(urls._matrix(held)), np.array([x == "block" for x in held.column("truth").to_pylist()])
    assert len(y) == 400 and (p[y][:, None] > p[~y][None, :]).mean() + (p[y][:, None] == p[~y][None, :]).mean() / 2 > 0.85
    one = spark.createDataFrame([("net", "/", "block", "u1"), ("net", "/", "allow", "u2"), ("net", "/", None, "u3")], "__host string, __path string, __label string, url string")
    got = {r.url: r["__suffix_rate"] for r in urls.with_statistics(one).collect()}
    folds = {r.url: r.fold for r in one.selectExpr("url", "pmod(xxhash64('fold', url), 5) AS fold").collect()}
    assert got["u3"] == 0.5 and (folds["u1"] == folds["u2"] or (got["u1"] < 0.5 < got["u2"]))


def test_op2_moves_texts_once(spark, tricky, monkeypatch):
    """The texts of the different lines come from one shuffle of the documents, by a merge join at any size; numbers of words are never null."""
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    staged = lines.staged
    monkeypatch.setattr(lines, "staged", seen)
    docs = spark.read.parquet(f"{tricky}/documents.parquet").select("doc_id", "text")
    texts = lines.distinct_lines(docs)[1]
    plan = plans["line-texts"]
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.line for r in texts.collect()} == {x for r in docs.collect() for x in (r.text or "").split("\n") if x.encode().split()}
    assert not lines.with_keys(texts, [1] * lines.COUNTERS).schema["k"].dataType.containsNull


def test_op2_all_pairs(spark, tricky):
    docs = {(d["doc_id"], d["text"]) for d in table(spark, tricky, "documents")}
    key = lambda t: int(np.array([xxhash.xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0])
    seen, want, inverse = [], {}, defaultdict(list)
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, key(d[1]))):
        keep = []
        for line in (text or "").split("\n"):
            w = set(line.encode().split())
            shared = Counter(j for t in w for j in inverse[t])
            if not w or not any(9 * n >= 4 * (len(w) + len(seen[j])) for j, n in shared.items()):
                keep.append(line)
            if w:
                for t in w:
                    inverse[t].append(len(seen))
                seen.append(w)
        want[(doc_id, text)] = "\n".join(keep) if text is not None else None
    got = lines.without_repeats(spark.read.parquet(f"{tricky}/documents.parquet").selectExpr("*", "text AS original")).collect()
    assert len(got) == len(table(spark, tricky, "documents"))
    assert all(r["text"] == want[(r["doc_id"], r["original"])] for r in got)


def test_op2_works_words_out_once(spark, tricky, monkeypatch):
    """Words are counted and numbered once, compiled but for the lambdas; a text's key is worked out once a text, not once a line."""
    calls = []
    ranks = lines.frequencies
    monkeypatch.setattr(lines, "frequencies", lambda x: calls.append(1) or ranks(x))
    docs = spark.read.parquet(f"{tricky}/documents.parquet").select("doc_id", "text")
    lines.kept_lines(docs).count()
    assert len(calls) == 1
    texts = lines.distinct_lines(docs)[1]
    plan = lines.prefixes(lines.with_keys(texts, [1] * lines.COUNTERS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("sort_array") == 1
    below = lines.split_lines(docs)._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[1]
    assert "xxhash64" in below


def test_op2_sorts_no_texts_to_find_lines(spark, tricky, monkeypatch):
    """Texts that meet chosen lines, and documents that meet what is kept of them, are not sorted for it; the filter by place is one comparison."""
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, label)

    staged = lines.staged
    monkeypatch.setattr(lines, "staged", seen)
    out = lines.without_repeats(spark.read.parquet(f"{tricky}/documents.parquet").select("doc_id", "text"))
    assert "ShuffledHashJoin" in plans["line-held"] and "SortMergeJoin" not in plans["line-held"]
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    cases = [(u, v, x, y) for u in (0, 4, 5, 2**31 - 1) for v in (4, 5) for x in (0, 4, 5, 2**31 - 1) for y in (4, 5)]
    sides = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, u int, v int, x int, y int")
    a, b = sides.selectExpr("i", "u", "v", "0L AS s1", "0L AS s2").alias("a"), sides.selectExpr("i", "x AS u", "y AS v", "0L AS s1", "0L AS s2").alias("b")
    got = {r.i for r in a.join(b, "i").where(lines.plausible("a", "b")).collect()}
    assert got == {i for i, (u, v, x, y) in enumerate(cases) if u >= y and x >= v and (v + y) // 4 >= 2 * ((v + y + 8) // 9)}


def test_op2_lines_about_the_long_ones(spark):
    """Lines at, just below and just above the threshold, on both sides of the length from which signatures have two halves; some parted by rare spaces."""
    rng = np.random.default_rng(3)
    rows, near = [], 0
    for k in range(260):
        n = int(rng.integers(1, 12)) if k % 4 == 0 else int(rng.integers(lines._LONG - 18, lines._LONG + 22))
        base = [f"w{x}" for x in rng.choice(4000, n, replace=False)]
        gone, added = int(rng.integers(0, n // 5 + 2)), int(rng.integers(0, n // 5 + 2))
        other = list(rng.permutation(base))[gone:] + [f"v{k}x{j}" for j in range(added)]
        near += abs((n - gone) / (n + added) - 0.8) < 0.03
        part = "\t" if k % 5 == 0 else "  " if k % 5 == 1 else " "
        rows += [(2 * k, " ".join(base)), (2 * k + 1, "a line of its own " + str(k) + "\n" + part.join(other))]
    assert near > 20
    seen, want = [], {}
    for doc_id, text in rows:
        keep = []
        for line in text.split("\n"):
            w = set(line.split())
            if w and not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                keep.append(line)
            seen.append(w)
        want[doc_id] = "\n".join(keep)
    got = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    n_gone = sum(a.count("\n") + 1 > b.count("\n") + (b != "") for a, b in zip(dict(rows).values(), want.values()))
    assert 60 < n_gone < 255


def test_op3_same_as_sql_and_targets(spark, tricky):
    got = registry.QUERIES["op3_mix_sources"](spark, tricky).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tricky}/documents.parquet/*.parquet'")
    want = con.sql(registry.SQL["op3_mix_sources"]).df()
    order = ["doc_id", "size", "taken"]
    a, b = (d.sort_values(order).reset_index(drop=True)[sorted(d.columns)] for d in (got, want))
    assert (a.fillna(-1).astype(float) == b.fillna(-1).astype(float)).all().all()
    assert (got.taken <= 2 * got["size"]).all() and (got.target <= 2 * got.source_size + 1e-9).all()


def plain_quality(t):
    """The columns of op4 from windows, and from all maximal repeats as pairs of equal places that can't be longer."""
    t = t or ""
    w = t.encode().split()
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    windows = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    best, by_word = [0] * len(w), defaultdict(list)
    for i, x in enumerate(w):
        by_word[x].append(i)
    for places in by_word.values():
        for i in places:
            for j in places:
                if i != j:
                    k = 0
                    while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best[i] = max(best[i], k)
    covered = {i + j for i, k in enumerate(best) if k >= 8 for j in range(k)}
    longest = max(best, default=0)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(windows) > 50 * len(w)
    long = longest >= 8 and (longest > 1000 or longest > 0.34 * len(w))
    return (len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in t), dup, len(windows), base, len(covered), longest, not (base or long or len(covered) > 0.4 * len(w)))


def test_op4_all_columns(spark, tricky, sf):
    docs = {d["doc_id"]: d["text"] for d in table(spark, sf, "documents") if len(d["text"] or "") < 6000}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept")
    got = {r.doc_id: tuple(r[n] for n in names) for r in registry.QUERIES["op4_quality_rules"](spark, sf).collect()}
    assert all(got[i] == plain_quality(t) for i, t in docs.items()) and len(docs) > 150
    assert len({g[-1] for g in got.values()}) == 2 and any(g[6] for g in got.values())


def test_op4_words(spark, tricky):
    for r in registry.QUERIES["op4_quality_rules"](spark, tricky).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    texts = ["a b c a b c", "x " * 40, None, "p q r s t u v w p q r s t u v w z", "l\nl\n\nm\nl"]
    for t, r in zip(texts, quality.judge(texts), strict=True):
        w = (t or "").split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        longest = max([0, *(k for i in range(len(w)) for j in range(len(w)) if i != j for k in range(1, len(w) + 1) if max(i, j) + k <= len(w) and w[i : i + k] == w[j : j + k])])
        assert (r["n_words"], r["n_repeat_words"], r["longest_repeat"]) == (len(w), len(inside), longest)
    assert quality.judge(["l\nl\n\nm\nl"])[0]["n_dup_lines"] == 2


@pytest.mark.parametrize("hot", [8192, 1])
def test_op5_every_byte(spark, tricky, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = table(spark, tricky, "documents")
    seen = Counter()
    raws = [(d["doc_id"], (d["text"] or "").encode()) for d in docs]
    for _, b in raws:
        seen.update(hash(b[k : k + 200]) for k in range(len(b) - 199))
    want = []
    for i, b in raws:
        hit = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                hit[k] += 1
                hit[k + 200] -= 1
        gone = np.cumsum(hit)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(spark.read.parquet(f"{tricky}/documents.parquet")).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 400


def test_op6_pieces_and_packing(spark, tricky):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in table(spark, tricky, "documents"):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        for p, s in enumerate([0, *range(first, len(ids), 1024)]):
            one = ids[s : first if p == 0 else s + 1024]
            want[(d["doc_id"], p, s, len(one), zlib.crc32(one.tobytes()))] += 1
    got = registry.QUERIES["op6_pack"](spark, tricky).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for s in at.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(at) <= sum(r.length for r in got) / 1024 * 1.02 + 1


def test_op6_long_runs_of_blanks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b " + c * 1_100_000 + "x<|endoftext|>é" for c in " \n"]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "start", "ids").collect()
    for i, text in enumerate(texts):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_op6_plan_holds_the_histogram():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(300, 420, 500), np.full(77, 513), np.zeros(0, int)):
        counts = np.bincount(lengths.astype(int), minlength=1025)
        held = np.zeros(1025, int)
        for content, n in packing.plan(counts):
            assert sum(content) <= 1024
            for c in content:
                held[c] += n
        assert (held == counts).all()


def test_op6_plan_keeps_patterns():
    """Patterns stay in the plan where they fit, and never cost more sequences than the smallest share of them."""
    counts = np.bincount(np.random.default_rng(6).integers(1, 1025, 5000), minlength=1025)
    made = packing.plan(counts)
    found = set(packing.patterns(counts, 1024))
    assert sum(n for c, n in made if tuple(sorted(c)) in found) > 100
    assert sum(n for _, n in made) <= 1.02 * sum(n for _, n in packing.best_fit(counts, 1024))


def test_op7_all_pairs(spark, tricky):
    docs = table(spark, tricky, "documents")

    def bits(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        return sum(1 << b for b in range(64) if s and 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s))

    rows = [(d["doc_id"], bits(d["text"])) for d in docs]
    got = [r for r in registry.QUERIES["op7_simhash"](spark, tricky).collect()]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter(rows)
    fp = sorted({f for _, f in rows})
    root = {f: f for f in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (a ^ b).bit_count() <= 3 and root[b] < root[a]:
                    root[a] = root[b]
    low = {}
    for i, f in rows:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    assert all(r.component_id == low.get(root[int(r.fingerprint, 16)]) for r in got)


def test_op7_code_covers():
    """Any two fingerprints at most 3 bits apart meet at an anchor: checked on the code of 31 bits."""
    rng = np.random.default_rng(3)
    syndrome = lambda w: int(np.bitwise_xor.reduce([p for p in range(1, 32) if w >> (p - 1) & 1] or [0]))
    home = lambda w: w ^ (1 << syndrome(w) - 1 if syndrome(w) else 0)
    for w in rng.integers(0, 1 << 31, 200).tolist():
        s = syndrome(w)
        away = {w ^ 1 << i - 1 ^ 1 << (i ^ s) - 1 for i in range(1, 32) if s and i != s and i < i ^ s}
        for b in range(31):
            x = w ^ 1 << b
            assert home(x) == home(w) or home(x) in away


def test_op7_links_across_the_sign_bit(spark):
    """Pairs that differ in bit 63 and up to two others are linked; those that differ in all of 59 to 63 are not."""
    rng = np.random.default_rng(7)
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    near, far, ids = [], [], []
    for flips in [(63,), (63, 0), (63, 1, 17), (63, 31, 59), (63, 62, 61), (5, 31, 40), (59, 60, 61, 62, 63), (0, 60, 61, 62, 63)]:
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << k for k in flips)
        (near if len(flips) <= 3 else far).append((signed(a), signed(b)))
        ids += [(signed(a),), (signed(b),)]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame(ids, "fp long")).collect()}
    assert got == {frozenset(p) for p in near}
    for a, b in near + far:
        assert bool(simhash._forest(np.array([a]), np.array([b]), 3)) == ((a, b) in near)


def test_op8_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.with_language(docs.select("doc_id", "text", "lang"), language.fit(docs)).where(language.held_out(col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred)[got.lang.notna()].mean() > 0.9 and got.score.between(0, 1).all()


def test_op8_every_label_is_learned(spark):
    """More labels than any list of the most frequent ones would hold; rare ones have a single document."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 8, f"l{i:03}") for i in range(330)] + [(1000 + i, "plain words of a common language " * 3, "common") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in docs.where(~language.held_out(col("doc_id"))).select("lang").collect()}
    net = language.fit(docs, documents=5, total=300)
    assert set(net.languages) == learned and len(learned) > 250
    assert net.predict(["plain words of a common language"])[0][0] in learned


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5), (2, "a b", "s", 6)], "doc_id long, text string, source string, n long")
    assert sorted(r["__size"] for r in mixing.with_copies(docs.withColumnRenamed("n", "__size")).collect()) == [2, 2]
    assert {r["__size"] for r in mixing.mix_documents(docs.withColumnRenamed("n", "__size")).collect()} <= {5, 6}
    assert sorted((r["__nos"], r.text) for r in lines.without_repeats(docs.withColumnRenamed("n", "__nos")).collect()) == [(5, "a b"), (6, "")]
    assert [r["__rule"] for r in urls.judge_urls(docs.withColumnRenamed("text", "url").withColumnRenamed("n", "__rule")).collect()] == [None, None]


def test_wide_tables_pass_through(spark, tricky):
    """Operators that keep other columns keep those that are named like their inputs' parts."""
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    n = docs.count()
    assert quality.quality_verdicts(docs).count() == n and lines.without_repeats(docs).drop("__n_lines", "__n_removed").columns == docs.columns
    assert mixing.mix_documents(docs).columns == docs.columns
    pages = spark.read.parquet(f"{tricky}/pages.parquet")
    assert urls.judge_urls(pages).count() == pages.count()


def test_op8_tricky(spark, tricky):
    got = {r.doc_id: r for r in registry.QUERIES["op8_language"](spark, tricky).collect()}
    assert [got[i].lang_pred for i in (9001, 9002, 9003, 9012)] == ["und"] * 4
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)


def test_op9_all_pairs(spark, tricky, sf):
    for d in (tricky, sf):
        rows = [(r["vec_id"], r["embedding"]) for r in table(spark, d, "embeddings")]
        ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
        near = [[len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95 for _, b in ok] for _, a in ok]
        low = [i if i is not None else 1 << 62 for i, _ in ok]
        for _ in ok:
            low = [min(x for x, hit in zip(low, row, strict=True) if hit) for row in near]
        want = Counter((i, sum(row) - 1, c, i == c) for (i, _), row, c in zip(ok, near, low, strict=True))
        want.update((i, 0, i, True) for i, v in rows if not any(i == j and v == w.tolist() for j, w in ok) and not (v and all(x is not None and np.isfinite(x) for x in v) and any(v)))
        assert Counter(tuple(r) for r in registry.QUERIES["op9_near_vectors"](spark, d).select("vec_id", "n_links", "component_id", "kept").collect()) == want


def test_op9_passes_and_recall(spark):
    """Passes grow with the vectors; lone pairs near the threshold among many others are found."""
    assert vectors.passes_for(50_000) == 16 < vectors.passes_for(10**6) < vectors.passes_for(10**8)
    rng = np.random.default_rng(14)
    base = rng.standard_normal((6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((600, 32))
    side -= (side * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    twin = 0.9505 * base[:600] + np.sqrt(1 - 0.9505**2) * side
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, twin]))]
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[6000 + i] == got[i] for i in range(600))
    assert found >= 594 and sum(got[i] != i for i in range(6000)) <= 2


def test_op10_round_trip(spark, tricky, tmp_path):
    pages = table(spark, tricky, "pages")
    last = {}
    for p in pages:
        b = (p["html"] or "").encode()
        last[b] = max([x for x in (last.get(b), p["page_id"]) if x is not None], default=None)
    want = Counter()
    for p in pages:
        b = (p["html"] or "").encode()
        same = p["page_id"] == last[b]
        want[(p["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else last[b])] += 1
    manifest = warc.write_archives(spark.read.parquet(f"{tricky}/pages.parquet"), f"file://{tmp_path}/w", archive_bytes=200)
    assert Counter(tuple(r) for r in warc.read_archives(manifest).collect()) == want and manifest.count() > 1
    path = manifest.first()["path"].removeprefix("file://")
    assert open(path, "rb").read(4) == b"\x5d\x2a\x4d\x18"
