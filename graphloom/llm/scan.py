"""Shared machinery: vectorised scans of Arrow text, scratch tables, connected components.

Texts are scanned as UTF-8 bytes straight out of the Arrow buffers. A batch is
cut into slices of about ``SLICE_BYTES`` (a longer text is a slice by itself),
so working memory is some 60 bytes per byte of the slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.operators.tables import Tables

SLICE_BYTES = 1 << 19

_Q = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words for letters and digits; every byte of a non-ASCII character counts.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[128:] = True
#: Bytes of words between white space (space, tab, line feed, VT, FF, CR).
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Slice:
    """Consecutive texts as one byte array; ``bounds[i]:bounds[i+1]`` is text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Slice]]:
    """(index of the first text, slice) over all texts; nulls are empty texts."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    first = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        _, offsets, body = chunk.buffers()
        offs = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), len(chunk))
            yield first + i, Slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j
        first += len(chunk)


def runs(s: Slice, member: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text indexes of the maximal runs of member bytes; none spans two texts."""
    n = len(s.data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = member[s.data if data is None else data]
    cut = np.zeros(n + 1, bool)
    cut[s.bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(s.bounds, starts, side="right") - 1


_M61 = np.uint64((1 << 61) - 1)
_LOW31, _LOW30, _LOW29, _LOW32 = (np.uint64((1 << k) - 1) for k in (31, 30, 29, 32))
_BASES = (0x1B873593CC9E2D51 % ((1 << 61) - 1), 0x165667B19E3779F9 % ((1 << 61) - 1))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _M61) + (x >> np.uint64(61))
    return np.where(x >= _M61, x - _M61, x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime 2**61 - 1 of numbers below it."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduce(np.uint64(2) * a1 * b1 + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + a0 * b0)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power_table(seed: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of a base (or of its inverse) modulo 2**61 - 1, made by doubling; long tables aren't kept."""
    if (have := _powers.get((seed, inverse))) is not None and len(have) >= n:
        return have[:n]
    base, size = pow(_BASES[seed], -1 if inverse else 1, int(_M61)), max(n, SLICE_BYTES + 1)
    out = np.ones(1, np.uint64)
    while len(out) < size:
        more = mul61(out[: size - len(out)], np.uint64(pow(base, len(out), int(_M61))))
        out = np.concatenate([out, more])
    if size == SLICE_BYTES + 1:
        _powers[seed, inverse] = out
    return out[:n]


def poly_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans that may overlap: values of a polynomial modulo the prime 2**61 - 1, finalised.

    A span's value is a difference of prefix sums, kept apart for the lower 32
    and the upper bits of the powers, over the power at its start. (A modulus
    that is a power of two would give equal values to some regular texts.)
    """
    n = len(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, values = _power_table(seed, False, n), data.astype(np.uint64) + np.uint64(1)
    sums = []
    for part in (powers & _LOW32, powers >> np.uint64(32)):
        part *= values
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(part, out=prefix[1:])
        sums.append(_reduce(prefix[ends] - prefix[starts]))
    low, high = sums
    high = _reduce(((high & _LOW29) << np.uint64(32)) + (high >> np.uint64(29)))
    h = mul61(_reduce(low + high), _power_table(seed, True, n)[starts])
    with np.errstate(over="ignore"):
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


#: Spans of more bytes are hashed by poly_hashes.
_BLOCKS = 256
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Blocks:
    """Bytes that can be read eight at a time from any position."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.words = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans: a chain over blocks of eight bytes, all spans' k-th blocks at once."""
        size = ends - starts
        with np.errstate(over="ignore"):
            h = mix(size.astype(np.uint64) + np.uint64((0x9FB21C651E98DF25 * (2 * seed + 1)) % (1 << 64)))
        own, k = np.flatnonzero((size > 0) & (size <= _BLOCKS)), 0
        while len(own):
            left = size[own] - k
            block = self.words[starts[own] + k] & _HEAD[np.minimum(left, 8)]
            with np.errstate(over="ignore"):
                h[own] = mix((h[own] ^ block) * _Q)
            k += 8
            own = own[left > 8]
        if len(long := np.flatnonzero(size > _BLOCKS)):
            # only their own bytes are looked at
            to = np.cumsum(size[long])
            body = np.concatenate([self.data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            h[long] = poly_hashes(body, to - size[long], to, seed)
        return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    return Blocks(data).hashes(starts, ends, seed)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` consecutive words, given the hashes of the words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, size):
            h *= _Q
            h += words[k : k + n]
        return mix(h)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True at the positions that any span ``[start, start+length)`` covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def list_array(values, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def give_back() -> None:
    """Returns free memory to the system: a Python worker lives on, idle, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, with its memory given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def append_columns(df: DataFrame, text: str, schema: str | T.StructType, make: Callable[[], Callable[[pa.Array], list]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, or all) and the columns of ``schema`` computed from each text.

    ``make()`` runs once in each task and returns a function from an Arrow array
    of texts to the arrays of the new columns. An input column that bears the
    name of a new one (in any case) is replaced by it.
    """
    new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {f.name.lower() for f in new}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = "__text"
    while source.lower() in {c.lower() for c in names}:
        source += "_"
    out = T.StructType([*(df.schema[c] for c in names), *new])
    kinds = [to_arrow_type(f.dataType) for f in new]
    wide = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(len(names)))
                made = [x if isinstance(x, pa.Array) and x.type == k else x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=wide)
                del made
            del batch
            give_back()

    quoted = [F.col(f"`{c}`") for c in names]
    return df.select(*quoted, F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, out)


# ---------------------------------------------------------------- scratch tables


class Scratch(Tables):
    """Tables written to the shared folder, to cut lineage where a plan is reused or iterated."""

    def save(self, df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
        """``df`` as a table; ``batch_bytes`` bounds its Arrow batches, where rows are large."""
        if not batch_bytes:
            return super().save(df)
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, batch_bytes)
        try:
            return super().save(df)
        finally:
            self.spark.conf.set(key, before)


# ---------------------------------------------------------------- components


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that each id in ``links`` (a, b: long) can reach.

    Alternating large-star and small-star steps; each is two shuffles on ids
    with a partial aggregation, and the links are never gathered per node. The
    number of rounds grows with the logarithm of the longest chain.
    """
    now = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = scratch.save(large)
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.save(small)
        scratch.drop(mid)
        marks = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for t in (now, new)]
        scratch.drop(now)
        now = new
        if marks[0] == marks[1]:
            break
    star = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
