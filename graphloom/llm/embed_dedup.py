"""Embedding near-dedup with a pivot-permutation index.

Reference vectors (pivots) are drawn from a bounded sample and kept apart: none
has a cosine of ``apart`` or more with another, so a large group of near copies
holds one pivot, not its share of them. Their number grows with the square root
of the number of vectors, so lists stay about as long as the table grows. Every
vector is described by its ``near`` nearest pivots in order. Vectors whose lists
share at least two pivots are candidates: the inverted lists are kept by pairs
of pivots, so that sharing a list is sharing two. A candidate pair is verified,
by cosine in double precision, and counts in the list of its two smallest shared
pivots only.

Equal vectors of a label are one representative with a count. Lists are cut
into chunks of ``chunk`` vectors and compared chunk by chunk, so no task holds
a whole list and no pairs are written out: each comparison gives link counts
and a spanning forest.

Defined results: a null, zero or non-finite vector, or one with a null label or
a null vec_id, links with nothing; vectors of different lengths don't link; rows
that repeat a vec_id are vectors of their own with that id. Other columns of the
table aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.scan import Scratch, components

#: Rows of a chunk compared at once.
_STRIP = 256


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _rows(lists: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The lists at ``rows``, all of length ``dim``, as a matrix."""
    at = lists.offsets.to_numpy()[rows]
    flat = lists.values.to_numpy(zero_copy_only=False)
    return flat[at[:, None] + np.arange(dim)]


def _apart(rows: list, most: int, apart: float) -> np.ndarray:
    """The first ``most`` of the vectors, in their order, that are no near copies of one taken before."""
    m = _unit(np.asarray(rows))
    free, taken = np.ones(len(m), bool), []
    while free.any() and len(taken) < most:
        taken.append(int(free.argmax()))
        free &= m @ m[taken[-1]] < apart
        free[taken[-1]] = False
    return m[taken]


def _assigner(by_dim: dict[int, np.ndarray], reach: int):
    """Adds each vector's nearest pivots, the nearest first; vectors of a length with few pivots all get the same two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = batch.column(2).to_numpy()
            best = np.tile(np.array([0, 1] + [-1] * (reach - 2), np.int32), (len(sizes), 1))
            for d in np.unique(sizes).tolist():
                if d in by_dim and len(by_dim[d]) > reach:
                    own = np.flatnonzero(sizes == d)
                    for k in range(0, len(own), 2048):
                        part = own[k : k + 2048]
                        sims = _unit(_rows(lists, part, d)) @ by_dim[d].T
                        best[part] = np.argsort(-sims, axis=1, kind="stable")[:, :reach]
            lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * reach, pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of], names=["rid", "label", "dim", "v", "copies", "pivots"])

    return run


def _own_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the two smallest pivots that each row of a shares with that of b (rows sorted, -1 for none)."""
    both = ((a[:, :, None] == b[:, None, :]).any(2)) & (a >= 0)
    one = both.argmax(1)
    rest = both.copy()
    rest[np.arange(len(a)), one] = False
    two = rest.argmax(1)
    at = np.arange(len(a))
    return np.where(rest.any(1), a[at, one].astype(np.int64) * 65536 + a[at, two], -1)


def _links(m: np.ndarray, pivots: np.ndarray, side: np.ndarray | None, key: int, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i, j), both ways, of linked rows that count under ``key``; with ``side``, of a row on it and one that isn't."""
    left, right = (np.arange(len(m)),) * 2 if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    found = []
    for k in range(0, len(left), _STRIP):
        near = m[left[k : k + _STRIP]] @ m[right].T >= cosine
        if np.count_nonzero(near) <= (len(near) if side is None else 0):  # each with itself at most
            continue
        i, j = np.nonzero(near)
        i, j = left[k + i], right[j]
        own = i != j
        i, j = i[own], j[own]
        own = _own_key(pivots[i], pivots[j]) == key
        found.append((i[own], j[own]))
    if not found:
        return None
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return (i, j) if side is None else (np.concatenate([i, j]), np.concatenate([j, i]))


def _comparer(cosine: float):
    """(rid, links, root) of the vectors with links in each comparison of two chunks."""
    names = ["label", "dim", "key", "b1", "b2", "c", "rid", "v", "copies", "pivots"]

    def groups(t: pa.RecordBatch, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        dim, key, b1, b2, c, ids, copies = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6, 8))
        rows = np.arange(t.num_rows)
        pivots = np.sort(_rows(t.column(9), rows, len(t.column(9)[0])), axis=1)
        units, place = {}, np.zeros(t.num_rows, np.int64)  # the vectors of each length, and where a row's is
        for d in np.unique(dim).tolist():
            own = rows[dim == d]
            units[d], place[own] = _unit(_rows(t.column(7), own, d)), np.arange(len(own))
        for first, last in bounds:
            many, own = last - first, slice(first, last)
            side = None if b1[first] == b2[first] else c[own] == b1[first]
            if many < 2 or (side is not None and side.all() | ~side.any()):
                continue
            at = place[first]
            pairs = _links(units[int(dim[first])][at : at + many], pivots[own], side, int(key[first]), cosine)
            if pairs is None or not len(pairs[0]):
                continue
            i, j = pairs
            links = np.zeros(many, np.int64)
            np.add.at(links, i, copies[own][j])
            root = np.arange(many)
            while True:
                new = root.copy()
                np.minimum.at(new, i, root[j])
                if (new == root).all():
                    break
                root = new
            at = np.unique(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own][at]), pa.array(links[at]), pa.array(ids[own][root[at]])], names=["rid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held = [*tail, *([batch] if batch is not None and batch.num_rows else [])]
            if not held or (batch is not None and len(held) == len(tail)):
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0].rename_columns(names)
            label = t.column(0).dictionary_encode().indices.to_numpy()
            keys = [label, *(t.column(k).to_numpy() for k in (1, 2, 3, 4))]
            new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            ends = np.append(new[1:], t.num_rows)
            done = len(new) if batch is None else len(new) - 1  # the last one may go on in the next batch
            if done:
                yield from groups(t.slice(0, int(ends[done - 1])), list(zip(new[:done].tolist(), ends[:done].tolist(), strict=True)))
            tail = [] if batch is None else [t.slice(int(new[-1]))]

    return run


def near_dups(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", cosine: float = 0.98, pivots: int = 256, near: int = 7, sample: int = 20_000, chunk: int = 1024, apart: float = 0.9, most: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    At least ``pivots`` pivots are used (as far as the sample has so many apart),
    twice the square root of the number of different vectors, ``most`` at most.
    """
    kind = vectors.schema[vec].dataType
    as_is = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    x = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec}`").cast(as_is).alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    good = F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    reps = scratch.save(x.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rid"), "label", F.size("v").alias("dim"), "v", "rep", "copies"))
    drawn = reps.select("dim", "v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("dim", "v").toArrow()
    if not drawn.num_rows:
        return x.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    wanted = max(pivots, min(most, int(2 * reps.count() ** 0.5)))
    dims, lists = drawn.column("dim").to_numpy(), drawn.column("v").combine_chunks()
    by_dim = {d: _apart(_rows(lists, np.flatnonzero(dims == d), d), wanted, apart) for d in np.unique(dims).tolist()}
    reach = max(2, near)
    schema = f"rid bigint, label string, dim int, v {as_is}, copies bigint, pivots array<int>"
    described = scratch.save(reps.select("rid", "label", "dim", "v", "copies").mapInArrow(_assigner(by_dim, reach), schema))
    at = [F.col("pivots")[i] for i in range(reach)]
    pairs = F.array(*[F.when(at[j] >= 0, F.least(at[i], at[j]).cast("bigint") * 65536 + F.greatest(at[i], at[j])) for i, j in combinations(range(reach), 2)])
    keyed = described.select("label", "dim", "rid", F.explode(F.array_compact(pairs)).alias("key"))
    lists_of = ["label", "dim", "key"]
    sizes = scratch.save(keyed.groupBy(*lists_of).agg(F.count("*").alias("n")).where("n > 1").select(*lists_of, F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    placed = keyed.join(sizes, lists_of).withColumn("c", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("rid", "key", "c", F.least("c", "other").alias("b1"), F.greatest("c", "other").alias("b2"))
    full = blocks.join(described, "rid").select(*lists_of, "b1", "b2", "c", "rid", "v", "copies", "pivots")
    block = [*lists_of, "b1", "b2"]
    found = scratch.save(full.repartition(*block).sortWithinPartitions(*block).mapInArrow(_comparer(cosine), "rid bigint, links bigint, root bigint"), batch_bytes=8 << 20)
    comp = scratch.save(components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), scratch).select(F.col("id").alias("rid"), "component"))
    lowest = comp.join(reps.select("rid", "rep"), "rid").groupBy("component").agg(F.min("rep").alias("lowest"))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    done = reps.join(links, "rid", "left").join(comp.join(lowest, "component"), "rid", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("lowest", "rep").alias("comp"))
    ids = x.where(good).join(done, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"))
    rest = x.where(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ids.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
