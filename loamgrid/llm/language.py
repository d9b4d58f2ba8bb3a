"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, read

#: Documents whose crc32 of the doc_id as text leaves remainder 0 are held out. Fixed by the contract.
FOLDS = 5
UNKNOWN = "und"
#: The network: bytes of a window, size of a byte's embedding, widths of the filters and how many of each.
WINDOW, EMBED, WIDTHS, EACH = 256, 8, (2, 3, 5), 16
#: The fit: about so many documents a language, fewer where that would be more than FIT_TOTAL, but one of each; windows a document, passes.
FIT_DOCUMENTS, FIT_TOTAL, FIT_WINDOWS, EPOCHS = 700, 140_000, 3, 6
BATCH, RATE, SEED = 64, 3e-3, 7
_STEP = WINDOW - max(WIDTHS) + 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without doc_id is, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def windows(text: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes, so that each run of filter-width bytes lies in one; zeros fill the last."""
    n = max(1, -(-max(len(text) - max(WIDTHS) + 1, 1) // _STEP))
    flat = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::_STEP]


class ByteNet:
    """Embedded bytes, filters of several widths, maximum over the window, softmax over the languages."""

    def __init__(self, languages: list[str]) -> None:
        rng = np.random.default_rng(SEED)
        self.languages, k = languages, max(WIDTHS) * EMBED
        self.mask = np.zeros((k, len(WIDTHS) * EACH), np.float32)  # a filter of width w sees the first w bytes of a run
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * EACH : (i + 1) * EACH] = 1
        new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"embed": new(256, EMBED, scale=0.5), "filter": new(*self.mask.shape, scale=0.3) * self.mask, "bias": np.zeros(self.mask.shape[1], np.float32), "out": new(self.mask.shape[1], max(1, len(languages)), scale=0.2), "shift": np.zeros(max(1, len(languages)), np.float32)}

    def _runs(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        runs = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(runs)

    def _pooled(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, t, k = runs.shape
        h = (runs.reshape(b * t, k) @ self.p["filter"]).reshape(b, t, -1)
        return h, np.maximum(h.max(axis=1) + self.p["bias"], 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), BATCH):
            z = self._pooled(self._runs(x[i : i + BATCH]))[1] @ self.p["out"] + self.p["shift"]
            z = z - z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam on cross-entropy. Gradients pass through the pooled runs only."""
        rng = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                xb, rows = x[at].copy(), np.arange(len(at))
                for r in np.flatnonzero(rng.random(len(at)) < 0.3):  # short texts, too
                    xb[r, rng.integers(6, WINDOW) :] = 0
                runs = self._runs(xb)
                h, pooled = self._pooled(runs)
                z = pooled @ self.p["out"] + self.p["shift"]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                q[rows, y[at]] -= 1
                q /= len(at)
                back = (q @ self.p["out"].T) * (pooled > 0)
                where = h.argmax(axis=1)
                best = runs[rows[:, None], where]
                grad = {"out": pooled.T @ q, "shift": q.sum(axis=0), "bias": back.sum(axis=0), "filter": np.einsum("bfk,bf->kf", best, back) * self.mask, "embed": np.zeros_like(self.p["embed"])}
                to_runs = (back[:, :, None] * self.p["filter"].T[None]).reshape(len(at), -1, max(WIDTHS), EMBED)
                bytes_at = xb[rows[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))]
                np.add.at(grad["embed"], bytes_at, to_runs)
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: log probabilities of its windows, weighted by their bytes, averaged and normalised."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> None:
            x = np.concatenate([w for _, w, _ in waiting])
            logp, at = self.log_probabilities(x), 0
            for i, w, weight in waiting:
                z = weight @ logp[at : at + len(w)] / weight.sum()
                at += len(w)
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                out[i] = (self.languages[k], float(min(1.0, max(0.0, p[k]))))

        for i, t in enumerate(texts):
            if not t or not self.languages or not any(map(str.isalpha, t)):
                continue
            raw = t.encode()
            w = windows(raw)
            weight = np.full(len(w), float(_STEP))
            weight[-1] = max(1, len(raw) - (len(w) - 1) * _STEP)
            waiting.append((i, w, weight))
            rows += len(w)
            if rows >= 4096:
                flush()
                waiting, rows = [], 0
        if waiting:
            flush()
        return out


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS, total: int = FIT_TOTAL) -> ByteNet:
    """A network fitted on labelled documents (doc_id, text, lang) that are not held out. Every label can be predicted.

    The sample is bounded: about ``documents`` a language, chosen by hash (fewer where all languages together would have
    more than ``total``, but at least the one with the lowest hash), and of each document FIT_WINDOWS pieces of a window's
    length at hashed places. Only these pieces and the labels go to the driver. Repeated rows and ties are chosen
    alike. Without labelled rows the network has no language and says ``und``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    u = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(u).alias("lowest"))
    names = sorted(r["lang"] for r in counts.select("lang").collect())  # one row a label
    net = ByteNet(names)
    if not names:
        return net
    each = max(1, min(documents, total // len(names)))
    labelled = labelled.join(checked_broadcast(counts, len(names)), "lang")
    share = F.lit(float(each)) / F.col("n")
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.length("text") - WINDOW, F.lit(1)).cast("long"))
    cut = [F.substring(F.col("text"), (place(k) + 1).cast("int"), F.lit(WINDOW)) for k in range(FIT_WINDOWS)]
    rows = labelled.where((u < share) | (u == F.col("lowest"))).select("lang", F.xxhash64("doc_id").alias("h"), F.array(*cut).alias("cut")).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    code = {n: i for i, n in enumerate(names)}
    x = [(windows(c.encode()[:WINDOW])[0], code[r["lang"]]) for r in rows.to_pylist() for c in r["cut"]]
    net.train(np.stack([a for a, _ in x]), np.array([b for _, b in x]))
    return net


def with_language(docs: DataFrame, net: ByteNet) -> DataFrame:
    """docs (text, any others) with lang_pred and score; ``und`` and 0 if the text is null or has no letter.

    Whole texts are read, in windows, however long. Each row is judged alone, so repeated rows agree; of tied languages the
    first in order of code points is named. Columns named lang_pred or score are replaced; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*keep)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = net.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(judged, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
