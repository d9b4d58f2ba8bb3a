"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, read, staged

#: (rule, verdict): host/path prefix. Fixed by the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that the trees are fitted on: those with the smallest hashes, at most so many.
FIT_ROWS = 20_000
#: Labelled rows are dealt by hash into so many folds for the statistics of suffixes.
FOLDS = 5
TREES = 40
DEPTH = 4
RATE = 0.2
BINS = 32
LEAST_LEAF = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "secure", "hyphens", "last_length", "has_extension", "suffix_share", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """urls (url, any others) with __host, __path, __rule and __label: the longest fitting rule and its verdict, or null."""
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("__host", host).withColumn("__path", path)
    rule = label = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # a longer one takes over
        name, _, prefix = text.partition("/")
        fits = ((F.col("__host") == name) | F.col("__host").endswith(f".{name}")) & F.col("__path").startswith(f"/{prefix}")
        rule, label = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(label)
    return urls.withColumn("__rule", rule).withColumn("__label", label)


def with_statistics(urls: DataFrame) -> DataFrame:
    """urls with statistics of the host's last label: its share of all rows, and the share of blocks among its labelled rows.

    A labelled row's share of blocks leaves out the rows of its own fold (FOLDS, by hash of the URL), so that no row is
    told its own label, nor are copies of it. One pass counts rows by (suffix, fold, label).
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    urls = urls.withColumn("__suffix", F.regexp_extract("__host", "([^.]*)$", 1)).withColumn("__fold", F.when(F.col("__label").isNotNull(), fold).otherwise(-1))
    by_fold = urls.groupBy("__suffix", "__fold").agg(F.count("*").alias("n"), F.count("__label").alias("m"), F.count_if(F.col("__label") == "block").alias("b"))
    by_fold = staged(by_fold, "url-suffixes")
    counted = by_fold.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    whole = by_fold.groupBy(F.col("__suffix").alias("__of")).agg(F.sum("n").alias("n_all"), F.sum("m").alias("m_all"), F.sum("b").alias("b_all"))
    per = by_fold.join(whole, F.col("__suffix") == F.col("__of")).select(
        "__of", F.col("__fold").alias("__of_fold"), (F.col("n_all") / (counted["n"] or 1)).alias("__suffix_share"),
        ((F.col("b_all") - F.col("b") + 1.0) / (F.col("m_all") - F.col("m") + 2.0)).alias("__suffix_rate"),
    )
    same = (F.col("__suffix") == F.col("__of")) & (F.col("__fold") == F.col("__of_fold"))
    return urls.join(checked_broadcast(per, counted["rows"]), same, "left").drop("__of", "__of_fold")


def features(url: list, host: list, path: list, stats: list[np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each URL; a null URL is an empty one."""
    out = np.zeros((len(url), len(FEATURES)))
    for i, (u, h, p) in enumerate(zip(url, host, path, strict=True)):
        u = u or ""
        rest = u.partition("#")
        query = rest[0].partition("?")[2]
        raw = np.frombuffer(u.encode(), np.uint8)
        share = np.bincount(raw)[np.unique(raw)] / max(len(raw), 1)
        last = p.rpartition("/")[2]
        out[i, :14] = (
            len(u), len(h), len(p), h.count(".") + 1, p.count("/"), sum(c in "0123456789" for c in u) / max(len(u), 1), -(share * np.log2(share)).sum() if len(raw) else 0.0,
            len([x for x in query.split("&") if x]), len(query), rest[1] == "#", u.startswith("https"), u.count("-"), len(last), "." in last,
        )
    out[:, 14:] = np.stack(stats, axis=1)
    return out


class BoostedTrees:
    """Logistic gradient boosting on binned features with Newton leaves; level by level, so all nodes of a depth split together."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(p / (1 - p)))
        bins, score = self._binned(x), np.full(len(y), self.start)
        for _ in range(TREES if len(y) else 0):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, y - q, q * (1 - q))
            self.trees.append(tree)
            score = score + RATE * self._leaf(tree, bins)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int64)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (DEPTH + 1) - 1
        feature, cut, value, node = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(len(g), np.int64)
        for depth in range(DEPTH + 1):
            first, width = 2**depth - 1, 2**depth
            at = node - first
            live = at >= 0
            total_g, total_h = (np.bincount(at[live], v[live], width) for v in (g, h))
            value[first : first + width] = total_g / (total_h + 1)
            if depth == DEPTH:
                break
            best = np.full(width, 1e-6)
            for f in range(bins.shape[1]):
                key = at[live] * BINS + bins[live, f]
                gl, hl, nl = (np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), axis=1) for v in (g[live], h[live], np.ones(live.sum())))
                gr, hr, nr = total_g[:, None] - gl, total_h[:, None] - hl, nl[:, -1:] - nl
                gain = np.where((nl >= LEAST_LEAF) & (nr >= LEAST_LEAF), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (total_g**2 / (total_h + 1))[:, None], 0)
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best
                best = np.where(better, gain[np.arange(width), b], best)
                feature[first : first + width][better], cut[first : first + width][better] = f, b[better]
            split = live & (feature[node] >= 0)
            node = np.where(split, 2 * node + 1 + (bins[np.arange(len(g)), np.maximum(feature[node], 0)] > cut[node]), node)
        return feature, cut, value

    def _leaf(self, tree: tuple, bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins, score = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            score = score + RATE * self._leaf(tree, bins)
        return 1 / (1 + np.exp(-score))


_INPUT = ("url", "__host", "__path", "__suffix_share", "__suffix_rate")


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    col = lambda n: batch.column(n)
    return features(col("url").to_pylist(), col("__host").to_pylist(), col("__path").to_pylist(), [np.asarray(col(n).to_pylist(), float) for n in _INPUT[3:]])


def fit(urls: DataFrame, rows: int = FIT_ROWS) -> BoostedTrees:
    """Trees fitted on at most ``rows`` different labelled URLs (__label block or allow), the first by hash: a bounded sample that goes to the driver. However often a URL is there, it counts once."""
    sample = urls.where("__label IS NOT NULL").select(*_INPUT, "__label").distinct().orderBy(F.xxhash64("url"), "url").limit(rows).toArrow()
    return BoostedTrees(_matrix(sample), np.array([x == "block" for x in sample.column("__label").to_pylist()], float))


def judge_urls(urls: DataFrame, rules: tuple = RULES, rows: int = FIT_ROWS) -> DataFrame:
    """urls (url, any others) with __host, __path, __rule, __block_probability and __verdict.

    URLs that a rule fits are the labelled ones: they keep the rule's verdict and train the trees, which judge the rest
    (block at a probability of at least 0.5). Null URLs and those without ``://`` have empty host and path. Without
    labelled URLs the trees say 0.5 for all. Repeated URLs get the same verdict, very long ones are read whole, and an
    empty table stays empty. Other columns pass through; those by the added names are replaced.
    """
    urls = urls.drop("__host", "__path", "__rule", "__label", "__suffix", "__fold", "__of", "__of_fold", "__suffix_share", "__suffix_rate", "__block_probability", "__verdict")
    urls = with_statistics(matched(urls, rules))
    model = fit(urls, rows)
    out_schema = urls.select("*", F.lit(0.0).alias("__block_probability")).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(_matrix(batch)))], names=[*batch.schema.names, "__block_probability"])

    found = urls.mapInArrow(judged, out_schema)
    return found.withColumn("__verdict", F.coalesce("__label", F.when(F.col("__block_probability") >= 0.5, "block").otherwise("allow")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__block_probability").alias("block_probability"))
