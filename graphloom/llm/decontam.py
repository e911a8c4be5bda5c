"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. A window is ``size`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. Every window of a document
is looked up by a 64-bit hash, first in a bit table, then in the sorted set,
and each hit is verified word by word against the window itself.

The set that is broadcast is bounded by ``max_bytes`` of window text. A larger
benchmark is cut by hash into blocks under that bound; each block is one more
scan of the documents, which carry the spans found so far.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no windows; a null item id is reported as ``null``; repeated
items or rows count as they stand (item ids are reported once a document); an
empty benchmark hits nothing. Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scan
from graphloom.llm.scan import Scratch, append_columns

HITS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, n, window): the distinct windows of each item, as words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items: list[str] = []
            lengths: list[int] = []
            windows: list[str] = []
            ids = batch.column(0).to_pylist()
            for first, s in scan.slices(batch.column(1)):
                low = scan.LOWER[s.data]
                starts, ends, doc = scan.runs(s, scan.ALNUM, low)
                raw = low.tobytes()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                edge = np.searchsorted(doc, np.arange(len(s) + 1)).tolist()
                for i in range(len(s)):
                    own = words[edge[i] : edge[i + 1]]
                    n = min(size, len(own))
                    for w in {b" ".join(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ():
                        items.append(ids[first + i])
                        lengths.append(n)
                        windows.append(w.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(lengths, pa.int32()), pa.array(windows, pa.string())], names=["item", "n", "window"])

    named = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return named.mapInArrow(run, "item string, n int, window string").distinct()


class WindowSet:
    """The windows by length: sorted hashes behind a bit table, and their texts and items."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for item, n, window in rows:
            key = window.encode()
            if key not in self.items:
                by_length[n].append(key)
            self.items[key].append(item)
        self.tables = {}
        for n, keys in by_length.items():
            data = np.frombuffer(b" ".join(keys), np.uint8)
            words = np.array([len(w) for k in keys for w in k.split(b" ")], np.int64)
            starts = np.cumsum(words + 1) - words - 1
            h = np.unique(scan.window_hashes(scan.span_hashes(data, starts, starts + words), n)[::n])
            bits = min(26, max(16, int(len(h) * 64).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[h >> np.uint64(64 - bits)] = True
            self.tables[n] = (h, bits, table)

    def find(self, s: scan.Slice) -> Iterator[tuple[int, int, list[tuple[int, int, list[str]]]]]:
        """(text, number of words, [(first word, past the last, items)]) of each text."""
        low = scan.LOWER[s.data]
        starts, ends, doc = scan.runs(s, scan.ALNUM, low)
        edge = np.searchsorted(doc, np.arange(len(s) + 1))
        hits: dict[int, list[tuple[int, int, list[str]]]] = defaultdict(list)
        words = scan.span_hashes(low, starts, ends)
        for n, (known, bits, table) in self.tables.items():
            h = scan.window_hashes(words, n)
            at = np.flatnonzero(table[h >> np.uint64(64 - bits)])
            at = at[doc[at] == doc[at + n - 1]] if len(at) else at
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]] if len(at) else at
            for k in at.tolist():
                window = b" ".join(low[a:b].tobytes() for a, b in zip(starts[k : k + n], ends[k : k + n], strict=True))
                if items := self.items.get(window):
                    i = int(doc[k])
                    hits[i].append((k - int(edge[i]), k - int(edge[i]) + n, items))
        for i in range(len(s)):
            yield i, int(edge[i + 1] - edge[i]), hits.get(i, [])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, max_bytes: int = 16 << 20, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted) and spans (merged word spans ``[start, end)``).

    Windows of more than ``max_bytes`` of text (Python holds them in some eight
    times that) are taken in blocks, one pass over the documents for each.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_id, item_text, size)
    total = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = 1 if total <= max_bytes else math.ceil(1.5 * total / max_bytes)
    if blocks > 1:
        scratch = scratch or Scratch(spark)
        windows = scratch.save(windows)
    out, old = docs, None
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()]))
        out = _scan(out, text, held, again=block > 0)
        if blocks > 1:
            out = scratch.save(out)
            held.unpersist()
            if old is not None:
                scratch.drop(old)
            old = out
    return out


def _scan(docs: DataFrame, text: str, held, again: bool) -> DataFrame:
    """One pass. ``again``: docs have items and spans of earlier passes, to be joined to these."""

    def make() -> Callable[[pa.Array], list]:
        known = held.value

        def work(texts: pa.Array) -> list:
            n_words, n_hit, items, spans = [], [], [], []
            for _, s in scan.slices(texts):
                for _, n, hits in known.find(s):
                    merged = _merge([(a, b) for a, b, _ in hits])
                    n_words.append(n)
                    n_hit.append(sum(b - a for a, b in merged))
                    items.append(sorted({x for _, _, own in hits for x in own}))
                    spans.append([{"start": a, "end": b} for a, b in merged])
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

        return work

    if not again:
        return append_columns(docs, text, HITS, make)
    before = docs.withColumnsRenamed({"items": "__items", "spans": "__spans"})
    now = append_columns(before, text, HITS, make)
    joined = F.array_sort(F.concat("__spans", "spans"))
    merged = F.aggregate(
        joined,
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    out = now.withColumn("items", F.array_sort(F.array_union("__items", "items"))).withColumn("spans", merged).drop("__items", "__spans")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]))


def is_contaminated(share: float = 0.05):
    """The rule over find_hits' columns: a hit, and hit words of at least this share (a decimal, taken exactly) of all words."""
    part = Fraction(str(share))
    return (F.col("n_hit") > 0) & (F.col("n_hit") * part.denominator >= F.col("n_words") * part.numerator)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """The documents that the rule leaves, with their own columns only.

    Helper columns are added under one name that the documents don't use.
    """
    packed = "__doc"
    while packed in docs.columns:
        packed += "_"
    text = options.pop("text", "text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(packed), F.col(f"`{text}`").alias("__scanned"))
    hits = find_hits(whole, benchmark, text="__scanned", **options)
    return hits.where(~is_contaminated(share)).select(F.col(f"{packed}.*"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with the hit words, and what stands between them, cut out of the text.

    A document without hits keeps its text byte for byte; a null text stays null.
    """
    packed = "__doc"
    while packed in docs.columns:
        packed += "_"
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(packed), F.col(f"`{text}`").alias("__scanned"))
    hits = find_hits(whole, benchmark, text="__scanned", **options)

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, own in zip(texts, spans, strict=True):
            if t is None or not len(own):
                out.append(t)
                continue
            raw = t.encode()
            s = scan.Slice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            starts, ends, _ = scan.runs(s, scan.ALNUM)
            kept, last = [], 0
            for x in own:
                kept.append(raw[last : starts[x["start"]]])
                last = int(ends[x["end"] - 1])
            out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "replace"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    fields = [cut("__scanned", "spans").alias(c) if c == text else F.col(f"{packed}.`{c}`") for c in docs.columns]
    return hits.select(*fields)
