"""Language ID by hierarchical discrimination.

Texts become relative frequencies of hashed byte n-grams (one to three bytes,
A-Z lower-cased). A linear support vector machine for each family against the
rest picks the family; within it, one machine for each pair of languages votes.
Machines are trained here by averaged stochastic subgradients on a bounded
sample (see fit_languages).

Families of known codes are fixed values; any other code is its own family.
Defined results: ``und`` with score 0 for a null text or one without letters;
without training rows every prediction is ``und``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import scan

# fixed values: language families of ISO 639-1 codes
FAMILY = {"da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic", "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "uk": "slavic"}
DIM = 1 << 12


def profiles(texts: pa.Array) -> np.ndarray:
    """One row of square-rooted n-gram frequencies, of length one, for each text."""
    out = []
    for _, s in scan.slices(texts, 1 << 18):
        n, size = len(s), len(s.data)
        x = np.zeros(n * DIM)
        low = scan.LOWER[s.data].astype(np.uint32)
        doc = np.repeat(np.arange(n), np.diff(s.bounds))
        for k in (1, 2, 3):
            if size < k:
                continue
            h = low[: size - k + 1].copy()
            for j in range(1, k):
                h = h * np.uint32(0x01000193) ^ low[j : size - k + 1 + j]
            h = (h * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
            same = doc[: size - k + 1] == doc[k - 1 :]
            x += np.bincount((doc[: size - k + 1] * DIM + h)[same], minlength=n * DIM)
        x = np.sqrt(x.reshape(n, DIM))
        out.append(x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None])
    return np.concatenate(out) if out else np.zeros((0, DIM))


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 12, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a hinge-loss machine; y is -1 or 1, weighted to equal classes."""
    rng, w, b = np.random.default_rng(7), np.zeros(x.shape[1]), 0.0
    total_w, total_b, t = np.zeros_like(w), 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            step = 1 / (strength * (t + 1000))
            wrong = part[y[part] * (x[part] @ w + b) < 1]
            w *= 1 - step * strength
            if len(wrong):
                c = weight[wrong] * y[wrong] / len(part)
                w += step * (c @ x[wrong])
                b += step * 0.01 * c.sum()
            total_w += w
            total_b += b
    return total_w / t, total_b / t


class Hierarchy:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        family = np.array([FAMILY.get(v, v) for v in lang])
        self.families = sorted(set(family.tolist()))
        self.top = [fit_svm(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.members = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in self.families}
        self.pairs = {}
        for own in self.members.values():
            for a, b in combinations(own, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x))
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        margins = np.stack([x @ w + b for w, b in self.top], 1) if self.top else np.ones((len(x), 1))
        best = margins.argmax(1)
        score = sure(margins.max(1)) if self.top else np.ones(len(x))
        lang = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, own = np.flatnonzero(best == k), self.members[f]
            votes = np.zeros((len(rows), len(own)))
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                w, c = self.pairs[a, b]
                p = sure(x[rows] @ w + c)
                votes[:, i] += p
                votes[:, j] += 1 - p
            pick = votes.argmax(1) if len(rows) else np.empty(0, np.int64)
            lang[rows] = np.array(own, object)[pick]
            if len(own) > 1 and len(rows):
                score[rows] *= votes.max(1) / (len(own) - 1)
        return lang.tolist(), np.clip(score, 0, 1)


def fit_languages(docs: DataFrame, sample: int = 1500, total: int = 12_000, languages: int = 200) -> Hierarchy:
    """Learns from documents whose crc32(doc_id as text) mod 4 is not 2.

    The ``languages`` most frequent ones are learned, of each at most ``sample``
    documents and of all together ``total``: those with the smallest hashes of
    their ids. One pass over the ids picks them; rows that repeat an id count once.
    """
    key = F.col("doc_id").cast("bigint").cast("string").cast("binary")
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key) % 4 != 2))
    ids = own.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return Hierarchy(np.zeros((0, DIM), np.float32), np.array([]))
    each = max(1, min(sample, total // len(counts)))
    # Twice as many are let through by their hash as are wanted, so that few rows are put in order.
    bars = [(r.lang, (1 << 63) - 1 if r.n <= 4 * each else int((2 * each / r.n) * (1 << 64)) - (1 << 63)) for r in counts]
    bar = docs.sparkSession.createDataFrame(bars, "lang string, bar long")
    few = ids.join(F.broadcast(bar), "lang").where("h <= bar").groupBy("lang", "h", "doc_id").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.withColumn("k", place).where(F.col("k") <= each).select("doc_id", "lang")
    got = own.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"]).select("lang", "text").toArrow()
    texts = got["text"].combine_chunks()
    x = [profiles(texts.slice(k, 256)).astype(np.float32) for k in range(0, len(texts), 256)]
    return Hierarchy(np.concatenate(x), np.array(got["lang"].to_pylist()))


def identify(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; whole texts are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs) * DIM weights

    def make():
        known = held.value

        def work(texts: pa.Array) -> list:
            langs, scores = [], []
            for k in range(0, len(texts), 256):
                part = texts.slice(k, 256)
                lang, score = known.predict(profiles(part))
                letters = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_pylist()
                langs += [v if on else "und" for v, on in zip(lang, letters, strict=True)]
                scores += [float(v) if on else 0.0 for v, on in zip(score, letters, strict=True)]
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return scan.append_columns(docs, text, "lang_pred string, score double", make)
