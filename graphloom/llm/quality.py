"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from vectorised passes over the bytes. Trees are grown on
feature histograms, depth first bounded, and flattened into arrays that numpy
traverses for all rows of a batch at once. At most ``sample`` labelled rows (the
smallest hashes of their ids) are used to fit; every document is scored.

Defined results: a null or empty text has all-zero statistics and is scored so;
null labels are not learned from; without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scan

_CLASSES = [np.isin(np.arange(256), list(x)) for x in (b"\n", b" ", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",", b"!?", b"<>{}[]|\\/", b"#@$%^&*_=+~", b":;-\"'()", b"aeiou", bytes(range(128, 256)))]
N_FEATURES = len(_CLASSES) + 11


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    rows = []
    for _, s in scan.slices(texts):
        n = len(s)
        x = np.zeros((n, N_FEATURES))
        size = np.diff(s.bounds).astype(float)
        per = np.maximum(size, 1)
        for k, member in enumerate(_CLASSES):
            c = np.concatenate([[0], np.cumsum(member[s.data])])
            x[:, k] = (c[s.bounds[1:]] - c[s.bounds[:-1]]) / per
        k = len(_CLASSES)
        starts, ends, doc = scan.runs(s, scan.NONSPACE)
        words = np.bincount(doc, minlength=n).astype(float)
        h = scan.span_hashes(s.data, starts, ends)
        length = (ends - starts).astype(float)
        one = np.maximum(words, 1)
        x[:, k], x[:, k + 1] = np.log1p(size), np.log1p(words)
        x[:, k + 2] = np.bincount(doc, length, n) / one
        x[:, k + 3] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / one - x[:, k + 2] ** 2, 0))
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.empty(0, bool)
        x[:, k + 4] = np.bincount(ds[new], minlength=n) / one
        runs = np.diff(np.append(np.flatnonzero(new), len(hs))) if len(hs) else np.empty(0)
        top = np.zeros(n)
        np.maximum.at(top, ds[new], runs)
        x[:, k + 5] = top / one
        x[:, k + 6] = np.bincount(doc, length > 20, n) / one
        x[:, k + 7] = np.bincount(doc, length < 3, n) / one
        two = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.empty(0, np.int64)
        x[:, k + 8] = np.bincount(doc[two], h[two] == h[two + 1], n) / one
        x[:, k + 9] = x[:, 3] * size / np.maximum(x[:, 4] * size, 1)
        x[:, k + 10] = words / np.maximum(x[:, 0] * size + 1, 1)
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))


class Forest:
    """Trees as arrays: feature, threshold, left child, leaf value; the right child follows the left."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, ...]]):
        self.base, self.trees = base, trees

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] > 0).any():
                go = left[at] + (x[row, feature[at]] > threshold[at])
                at = np.where(inner, go, at)
            raw += value[at]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, smooth: float = 1.0, least: int = 10) -> Forest:
    if not len(y):
        return Forest(0.0, [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    nf = x.shape[1]
    flat = binned + np.arange(nf) * bins
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    raw, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, left, value = [0], [0.0], [0], [0.0]
        level = [(0, np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = rate * gs / (hs + smooth)
                if d == depth or len(rows) < 2 * least:
                    raw[rows] += value[node]
                    continue
                idx = flat[rows].ravel()
                hist = [np.bincount(idx, np.repeat(w, nf), nf * bins).reshape(nf, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    raw[rows] += value[node]
                    continue
                low = binned[rows, f] <= b
                feature[node], threshold[node], left[node] = int(f), float(edges[f][b]), len(left)
                for part in (rows[low], rows[~low]):
                    following.append((len(left), part))
                    feature.append(0)
                    threshold.append(0.0)
                    left.append(0)
                    value.append(0.0)
            level = following
        out.append((np.array(feature), np.array(threshold), np.array(left), np.array(value)))
    return Forest(base, out)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Forest:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0; at most ``sample`` of them.

    An id with several labels has the largest, and of several documents with one
    id one row of statistics is used. Without labelled documents the score is 0.5.
    """
    key = F.col("doc_id").cast("bigint")
    own = labels.where(F.col("quality").isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 5 != 0)).groupBy(key.alias("__id")).agg(F.max(F.col("quality").cast("double")).alias("__y"))
    few = docs.select(key.alias("__id"), F.col("text").alias("__text")).join(F.broadcast(own.orderBy(F.xxhash64("__id"), "__id").limit(sample)), "__id")

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    seen = few.select("__id", "__y", "__text").mapInArrow(run, "id bigint, y double, x array<double>")
    got = seen.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).orderBy("id").select("r.*").collect()
    return fit_forest(np.array([r.x for r in got]).reshape(len(got), N_FEATURES), np.array([r.y for r in got]))


def score_quality(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the threshold on)."""

    def make():
        def work(texts: pa.Array) -> list:
            s = forest.score(statistics(texts))
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return work

    return scan.append_columns(docs, text, "score double, predicted int", make)
