"""Language identification with a byte convolutional network.

Windows of fixed length slide over the whole text; each byte is embedded, filters
of several widths run over the window, the largest response of each filter feeds
a softmax.  Everything is numpy: training is Adam on a bounded sample of labelled
windows, prediction runs in batches of windows inside ``mapInArrow``.  A text's
probability vector is the mean of its windows' vectors, weighted by their length
and by how much of them is not repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED = 6
FILTERS = 10
#: Bound of the labelled training sample, over all languages together.
SAMPLE_DOCS = 3000
EPOCHS = 14
UNKNOWN = "und"


class ByteCnn:
    """Parameters and both passes of the network."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["out"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(labels), dtype=np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Class probabilities of windows of byte codes (256: padding), and what backward needs."""
        e = self.p["embed"][x]
        keep, pooled = {"x": x}, []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            kernel = self.p[f"conv{w}"].reshape(w, EMBED, FILTERS)
            out = e[:, :n] @ kernel[0]
            for k in range(1, w):
                out += e[:, k : k + n] @ kernel[k]
            at = out.argmax(1)
            best = np.take_along_axis(out, at[:, None], 1)[:, 0] + self.p[f"bias{w}"]
            keep[w] = (at, best > 0)
            pooled.append(np.maximum(best, 0))
        h = np.concatenate(pooled, 1)
        keep["h"] = h
        z = h @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), keep

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        probs, keep = self.forward(x)
        b = len(x)
        dz = probs
        dz[np.arange(b), y] -= 1
        dz /= b
        g = {"out": keep["h"].T @ dz, "out_bias": dz.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = dz @ self.p["out"].T
        for i, w in enumerate(WIDTHS):
            at, live = keep[w]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * live
            g[f"bias{w}"] = d.sum(0)
            codes = x[np.arange(b)[:, None, None], at[:, :, None] + np.arange(w)]  # b, filters, w
            e = self.p["embed"][codes]  # b, filters, w, embed
            kernel = self.p[f"conv{w}"].reshape(w, EMBED, FILTERS)
            g[f"conv{w}"] = np.einsum("bfke,bf->kef", e, d).reshape(w * EMBED, FILTERS)
            np.add.at(g["embed"], codes, np.einsum("kef,bf->bfke", kernel, d))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> ByteCnn:
        """Adam with a fixed seed: reruns agree."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                step += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, windows: np.ndarray, batch: int = 128) -> np.ndarray:
        if not len(windows):
            return np.zeros((0, len(self.labels)), dtype=np.float32)
        return np.concatenate([self.forward(windows[i : i + batch])[0] for i in range(0, len(windows), batch)])


def windows_of(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows that cover all bytes, the last one padded; and their weights."""
    n = max(1, -(-len(raw) // window))
    flat = np.full(n * window, 256, dtype=np.int16)
    flat[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.full(n, window, dtype=np.float64)
    sizes[-1] = max(1, len(raw) - (n - 1) * window)
    return flat.reshape(n, window), sizes


def novelty(raw: bytes, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Weights of windows: their size times the share of their 8-byte shingles that the text has not had before.

    So a sentence that fills half a text by repetition speaks once.
    """
    if len(raw) < 8:
        return sizes
    flat = np.frombuffer(raw, dtype=np.uint8)
    shingles = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)).view("<u8")[:, 0]
    first = np.unique(shingles, return_index=True)[1]
    seen, new = (np.bincount(at // window, minlength=len(sizes)) for at in (np.arange(len(shingles)), first))
    return sizes * (new + 1) / (seen + 1)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, window: int = WINDOW) -> ByteCnn | None:
    """Fit on a bounded, stratified sample of rows (doc_id, text, lang); None without any.

    Three windows are taken of each sampled text, spread over its whole length.
    """
    counts = {r[0]: r[1] for r in labelled.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()}
    labels = sorted(counts)
    if not labels:
        return None
    each = max(1, sample_docs // len(labels))
    share = F.lit(0)
    for lang in labels:
        share = F.when(F.col("lang") == lang, max(1, min(1_000_000, each * 1_000_000 // counts[lang]))).otherwise(share)
    n = F.length("text")
    places = [F.lit(1), F.greatest(F.lit(1), (n / 2).cast("int")), F.greatest(F.lit(1), n - window)]
    rows = (
        labelled.where("lang IS NOT NULL AND text IS NOT NULL")
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
        .select("doc_id", "lang", *(F.col("text").substr(p, F.lit(window)).alias(f"w{i}") for i, p in enumerate(places)))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "w0", "lang")
        .limit(2 * sample_docs)
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["w0"]))
    x, y = [], []
    for r in rows:
        for part in {r["w0"], r["w1"], r["w2"]} - {""}:
            x.append(windows_of(part.encode("utf-8", "surrogatepass")[:window], window)[0][0])
            y.append(labels.index(r["lang"]))
    if not x:
        return None
    order = np.lexsort(np.array(x).T[:4])  # a set has no order of its own
    return ByteCnn(labels).fit(np.array(x)[order], np.array(y)[order])


def identify(docs: DataFrame, model: ByteCnn | None, window: int = WINDOW, batch: int = 128) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts when there was nothing to learn from.  Of languages with equal scores the
    first by name is taken.  Repeated rows get equal results; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    ship(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, scores = [], []
            group, owners, sizes = [], [], []
            texts = [t.as_py() for t in rows.column(1)]
            live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            total = np.zeros((len(texts), len(model.labels)))

            def flush() -> None:
                if group:
                    np.add.at(total, np.concatenate(owners), model.predict(np.concatenate(group), batch) * np.concatenate(sizes)[:, None])
                    group.clear(), owners.clear(), sizes.clear()

            held = 0
            for i in live:
                raw = texts[i].encode("utf-8", "surrogatepass")
                w, s = windows_of(raw, window)
                group.append(w), owners.append(np.full(len(w), i)), sizes.append(novelty(raw, s, window))
                held += len(w)
                if held >= 4096:
                    flush()
                    held = 0
            flush()
            for i in range(len(texts)):
                all_of = total[i].sum()
                best = int(total[i].argmax())
                names.append(model.labels[best] if all_of else UNKNOWN)
                scores.append(float(min(1.0, total[i, best] / all_of)) if all_of else 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
