"""Exact substring dedup: every passage of ``least`` bytes that stands in two places.

A window is ``least`` consecutive bytes of a text. Its anchor is the position of
the smallest hash among its runs of 32 bytes (the leftmost, of equal ones), so
equal windows have equal anchors at equal offsets, whatever surrounds them.
Anchors whose hash occurs once in the corpus end the matter for their windows.
Of the others, the bytes of their windows are gathered by the hash of the
anchor, and all their windows are compared with each other. A passage is a
maximal stretch of bytes that windows which occur more than once cover, so its
borders are exact to the byte; one of fewer than ``words`` words isn't reported.
The occurrence of a window with the smallest document id (and offset) is kept;
the others are removable, and ``remove_passages`` cuts them out.

Defined results: null or empty texts have no windows; rows that repeat both id
and text are one document; null is an id like any other, and the last in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import scan

_RUN = 32
_BYTE = scan.mix(np.arange(1, 257, dtype=np.uint64))
_ODD = scan.mix(np.arange(301, 306, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes gathered before a part of the anchors is compared.
_PART = 1 << 20


def anchors(s: scan.Slice, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a slice, in order; windows by their first byte."""
    n, run = len(s.data), min(_RUN, 1 << (least.bit_length() - 1))
    if n < least:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    with np.errstate(over="ignore"):
        h, size = _BYTE[s.data], 1
        for odd in _ODD[: run.bit_length() - 1]:
            h = h[:-size] * odd + h[size:]
            size *= 2
        h = scan.mix(h)
    low, size, wide = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, least - run + 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if wide > size:
        low = np.minimum(low[: size - wide], low[wide - size :])
    ends = np.repeat(s.bounds[1:], np.diff(s.bounds))
    at = np.flatnonzero(np.arange(len(low)) + least <= ends[: len(low)])
    if not len(at):
        return at, at, at
    q = (low[at] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    return h[q[new]].view(np.int64), at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]


def _hashes(least: int):
    """(row, h) -> one row for each hash among the anchors of a text, and how often it has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, s in scan.slices(batch.column(1)):
                h, at, _ = anchors(s, least)
                if not len(h):
                    continue
                doc = np.searchsorted(s.bounds, at, side="right") - 1
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + doc[new])), pa.array(h[new]), pa.array(np.diff(np.append(new, len(h))).astype(np.int32))], names=["row", "h", "n"])

    return run


#: A place that has some bytes: document (and whether its id is null), row, offset, words before it.
_PLACE = np.dtype([("null", "u1"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("before", "<i4")])


def _contexts(least: int):
    """The bytes of the windows of each anchor whose hash is in the list of its text, and the places that have them.

    Equal bytes within a slice are one row, so that copies and texts that repeat
    themselves make few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            for first, s in scan.slices(batch.column(2)):
                h, at, last = anchors(s, least)
                if not len(h):
                    continue
                doc = np.searchsorted(s.bounds, at, side="right") - 1
                cut = np.searchsorted(doc, np.arange(len(s) + 1))
                own = np.concatenate([np.isin(h[a:b], wanted[first + i].values.to_numpy()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
                h, at, last, doc = h[own], at[own], last[own], doc[own]
                if not len(h):
                    continue
                starts = scan.runs(s, scan.NONSPACE)[0]
                before = np.searchsorted(starts, at) - np.searchsorted(starts, s.bounds[doc])
                body = s.data.tobytes()
                coded = pa.array([body[a:b] for a, b in zip(at.tolist(), (last + least).tolist(), strict=True)], pa.binary()).dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                many = np.bincount(code, minlength=len(coded.dictionary))
                head = order[np.cumsum(many) - many]
                ids, rows = batch.column(0), first + doc[order]
                places = np.empty(len(order), _PLACE)
                places["null"] = ids.is_null().to_numpy(zero_copy_only=False)[rows]
                places["doc"] = pc.fill_null(ids, 0).to_numpy()[rows]
                places["row"] = batch.column(1).to_numpy()[rows]
                places["at"], places["before"] = (at - s.bounds[doc])[order], before[order]
                ends = pa.py_buffer((np.append(0, np.cumsum(many)) * _PLACE.itemsize).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(many), [None, ends, pa.py_buffer(places.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(h[head]), packed, coded.dictionary], names=["h", "places", "body"])

    return run


def _compare(least: int):
    """Stretches of windows that occur more than once; ``later`` where an earlier occurrence is kept.

    w0 and w1 count the words of the document that begin before the stretch and before its end.
    """
    names = ["doc_id", "row", "first", "last", "later", "w0", "w1"]

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        packed = pa.concat_arrays(t.column("places").chunks)
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        places = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_PLACE)
        of = np.repeat(np.arange(t.num_rows), np.diff(ends) // _PLACE.itemsize)
        h = t.column("h").to_numpy()[of]
        # by anchor, and then as documents are ordered
        order = np.lexsort((places["at"], places["row"], places["doc"], places["null"], h))
        of, h, places = of[order], h[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (places["row"][1:] != places["row"][:-1]) | (places["at"][1:] != places["at"][:-1])]))
        of, places = of[new], places[new]
        at, before = places["at"].astype(np.int64), places["before"].astype(np.int64)
        # Equal bodies are hashed once; the dictionary has them in the order of their first rows.
        coded = pa.concat_arrays(t.column("body").chunks).dictionary_encode()
        kinds, head, code, copies = np.unique(coded.indices.to_numpy()[of], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(head)
        head, copies, body = head[order], copies[order], coded.dictionary.take(pa.array(kinds[order]))
        code = np.argsort(order)[code]
        offs = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        many = np.diff(offs) - least + 1
        own = np.repeat(np.arange(len(many)), many)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        p = offs[own] + inner
        _, one, which = np.unique(scan.poly_hashes(data, p, p + least), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=copies[own])
        state = (n[which] > 1) * np.where(one[which] == np.arange(len(p)), 1, 2)
        new = np.flatnonzero(np.concatenate([[True], (state[1:] != state[:-1]) | (own[1:] != own[:-1])]))
        end = np.append(new[1:], len(p)) - 1
        end, new = end[state[new] > 0], new[state[new] > 0]
        again = np.setdiff1d(np.arange(len(code)), head)
        rows = np.concatenate([head[own[new]], again])
        first = np.concatenate([inner[new], np.zeros(len(again), np.int64)])
        last = np.concatenate([inner[end], many[code[again]] - 1])
        later = np.concatenate([state[new] == 2, np.ones(len(again), bool)])
        begins = np.zeros(len(data) + 1, np.int64)
        begins[2:] = np.cumsum(scan.NONSPACE[data[1:]] & ~scan.NONSPACE[data[:-1]] & ~np.isin(np.arange(1, len(data)), offs[:-1]))
        base = offs[code[rows]]
        words, at = before[rows] - begins[base], at[rows]
        doc_ids = pa.array(places["doc"][rows], mask=places["null"][rows] > 0)
        cols = [doc_ids, *map(pa.array, (places["row"][rows], at + first, at + last, later, words + begins[base + first], words + begins[base + last + least]))]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            if size >= _PART:
                # Only whole anchors are compared: what has the hash of the last row held is still of that part.
                same = int(np.searchsorted(h != held[-1].column(0)[-1].as_py(), True))
                if same < len(h):
                    yield from close([*held, batch.slice(0, same)])
                    held, size, batch = [], 0, batch.slice(same)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from close(held)

    return run


def _union(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, words) of what the spans (start, end, words before either), in order, cover together."""
    out: list[list[int]] = []
    for a, b, w0, w1 in spans:
        if not out or a > out[-1][1]:
            out.append([a, b, w0, w1])
        elif b > out[-1][1]:
            out[-1][1], out[-1][3] = b, w1
    return [(a, b, w1 - w0) for a, b, w0, w1 in out]


_SPANS = "array<struct<start: bigint, end: bigint>>"


def _passages(docs: DataFrame, id_col: str, text: str, least: int, words: int) -> DataFrame:
    """As repeated_passages, with ``row``, which tells the texts of an id apart."""
    named = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    named = named.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    hashes = named.select("row", "text").mapInArrow(_hashes(least), "row bigint, h bigint, n int")
    # A table of its own, so that the join of a frequent hash with it is one that adaptive execution splits.
    often = scan.Scratch(docs.sparkSession).save(hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    wanted = hashes.select("row", "h").join(often, "h").groupBy("row").agg(F.collect_set("h").alias("wanted"))
    found = named.join(wanted, "row").select("doc_id", "row", "text", "wanted").mapInArrow(_contexts(least), "h bigint, places binary, body binary")
    dealt = found.repartition("h").sortWithinPartitions("h")
    spans = dealt.mapInArrow(_compare(least), "doc_id bigint, row bigint, first bigint, last bigint, later boolean, w0 bigint, w1 bigint")
    own = spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("first", "last", "later", "w0", "w1"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pieces = lambda xs: _union([(x["first"], x["last"] + least, x["w0"], x["w1"]) for x in xs])
                all_ = [p for p in pieces(found) if p[2] >= words]
                if not all_:
                    continue
                starts = [p[0] for p in all_]
                gone = [g for g in pieces([x for x in found if x["later"]]) if (k := bisect_right(starts, g[0])) and g[1] <= all_[k - 1][1]]
                out.append((doc, row, len(all_), sum(b - a for a, b, _ in all_), sum(b - a for a, b, _ in gone), *([{"start": a, "end": b} for a, b, _ in spans] for spans in (all_, gone))))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * 2
            names = ["doc_id", "row", "n_passages", "n_bytes", "n_removable", "spans", "removable"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return own.select("doc_id", "row", "c").mapInArrow(run, f"doc_id bigint, row bigint, n_passages bigint, n_bytes bigint, n_removable bigint, spans {_SPANS}, removable {_SPANS}")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 120, words: int = 0) -> DataFrame:
    """(doc_id, n_passages, n_bytes, n_removable, spans, removable) of the documents that have repeated passages.

    Both lists are byte offsets; ``removable`` leaves out what is kept as a first occurrence.
    """
    return _passages(docs, id_col, text, least, words).drop("row")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 120, words: int = 0) -> DataFrame:
    """The documents, all columns, without the removable spans of their texts; a cut inside a character takes all of it."""
    gone = _passages(docs, id_col, text, least, words).select(F.col("doc_id").alias("__gone_id"), F.col("row").alias("__gone_row"), F.col("removable").alias("__gone"))
    number, body = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text}`").cast("string")
    joined = docs.join(gone, number.eqNullSafe(F.col("__gone_id")) & (F.xxhash64(number, body) == F.col("__gone_row")), "left").drop("__gone_id", "__gone_row")
    k, names = docs.columns.index(text), docs.columns

    def cut(whole: str, spans: list[dict]) -> str:
        raw, at, parts = whole.encode(), 0, []
        for x in spans:
            parts.append(raw[at : x["start"]])
            at = x["end"]
        return b"".join([*parts, raw[at:]]).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(len(names)).is_valid()
            rows = pa.array(np.flatnonzero(some.to_numpy(zero_copy_only=False)))
            texts = batch.column(k)
            new = [cut(*x) for x in zip(texts.take(rows).to_pylist(), batch.column(len(names)).take(rows).to_pylist(), strict=True)]
            columns = [*batch.columns[: len(names)]]
            columns[k] = pc.replace_with_mask(texts, some, pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = T.StructType([T.StructField(c, T.StringType()) if c == text else docs.schema[c] for c in names])
    return joined.select(*[body.alias(c) if c == text else F.col(f"`{c}`") for c in names], "__gone").mapInArrow(run, out)
