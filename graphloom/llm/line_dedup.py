"""Line dedup over overlapping windows of three lines.

Lines end at line feeds. Every three consecutive lines of a document are a
window, known by a 128-bit hash. Documents are ordered by id, windows within
one by position; the first occurrence of a window stays and the lines covered
by any later occurrence go (covered positions are merged, so a line goes once).

Shuffles carry hashes and positions only, until the removals of each document
meet its text. The first occurrences of repeated windows are written as a table
of their own, so that the join of a frequent window with it is one that
adaptive execution splits.

Defined results: a null or empty text, or one of fewer than three lines, stays
as it is; a null text has no lines. Rows that share an id but not a text are
documents of their own (in the order of a hash of the text); rows that repeat
both are treated alike, each as the first of them would be. A null id is an id,
the first in order. Input columns named n_lines or n_removed are replaced if
counts are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import scan


def line_windows(docs: DataFrame, id_col: str, text: str, size: int = 3) -> DataFrame:
    """(id, row, pos, h1, h2): the windows of each document; row tells texts of an id apart, pos is the first line's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, s in scan.slices(batch.column(2)):
                if not len(s.data):
                    continue
                feeds = np.flatnonzero(s.data == 10)
                starts = np.concatenate([s.bounds[:-1], feeds + 1])
                own = np.concatenate([np.arange(len(s)), np.searchsorted(s.bounds, feeds, side="right") - 1])
                order = np.lexsort((starts, own))
                starts, doc = starts[order], own[order]
                ends = np.minimum(np.concatenate([starts[1:] - 1, s.bounds[-1:]]), s.bounds[doc + 1])
                ends = np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), s.bounds[doc + 1], ends)
                blocks = scan.Blocks(s.data)
                h = [scan.window_hashes(blocks.hashes(starts, ends, k), size) for k in (0, 1)]
                n = len(h[0])
                if not n:
                    continue
                keep = np.flatnonzero(doc[:n] == doc[size - 1 :])
                edge = np.searchsorted(doc, doc[keep])
                rows = pa.array(first + doc[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keep - edge, pa.int32()), pa.array(h[0][keep].view(np.int64)), pa.array(h[1][keep].view(np.int64))], names=["id", "row", "pos", "h1", "h2"])

    body = F.col(f"`{text}`").cast("string")
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    return named.mapInArrow(scan.tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, row bigint, pos int, h1 bigint, h2 bigint")


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, row, at): first lines of the windows that repeat an earlier one, for each document that has some."""
    windows = line_windows(docs, id_col, text, size)
    place = F.struct("id", "row", "pos")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(scan.Scratch(docs.sparkSession).save(first), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def _cut(text: str, at: list[int], size: int) -> tuple[str, int]:
    """The text without the windows of lines that begin ``at``, and how many lines went."""
    lines = text.split("\n")
    gone = scan.covered(np.array(at), size, len(lines))
    return "\n".join(line for line, g in zip(lines, gone.tolist(), strict=True) if not g), int(gone.sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, counts: bool = False) -> DataFrame:
    """The documents with repeated lines cut out of their texts; ``counts`` adds n_lines and n_removed."""
    gone = removals(docs, id_col, text, size).toDF("__gone_id", "__gone_row", "__gone_at")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__gone_row"))
    names = [c for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    k = names.index(text)
    fields = [T.StructField(c, T.StringType()) if c == text else docs.schema[c] for c in names]
    more = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")] if counts else []
    wide = [f.name for f in (*fields, *more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(k), batch.column(len(names))
            some = at.is_valid()
            rows = pa.array(np.flatnonzero(some.to_numpy(zero_copy_only=False)))
            cut = [_cut(t, p, size) for t, p in zip(texts.take(rows).to_pylist(), at.take(rows).to_pylist(), strict=True)]
            columns = [*batch.columns[: len(names)]]
            columns[k] = pc.replace_with_mask(texts, some, pa.array([c[0] for c in cut], texts.type))
            if counts:
                n = pc.fill_null(pc.add(pc.cast(pc.count_substring(texts, "\n"), pa.int64()), 1), 0)
                zeros = pa.array(np.zeros(batch.num_rows, np.int64))
                columns += [n, pc.replace_with_mask(zeros, some, pa.array([c[1] for c in cut], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=wide)

    quoted = [F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return docs.join(gone, same, "left").select(*quoted, "__gone_at").mapInArrow(scan.tidy(run), T.StructType([*fields, *more]))
