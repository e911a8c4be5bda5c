"""Near-duplicate documents by the Jaccard similarity of word shingles, exactly.

Words are runs of non-white-space, A-Z lower-cased; a document's set holds its
distinct five-word shingles as 64-bit hashes (all its words as one, if fewer).
Documents with equal sets are one class. An inverted index over token ranges
finds the shingles that two classes share; any other can't be in an overlap.
Shingles that a sample of classes shows to be frequent are dealt by class, not
by range, and count as shared, so no task gathers the owners of one.

Under any one order of all tokens, two sets of similarity t share a token among
the first n - ceil(t n) + 1 of each. Several orders are used (by rising
magnitude of the document frequency, ties by different hashes). Every link
comes from them: pairs that share a prefix token under the first order are
named; a pair is a candidate only if it shares one under each of the others too
(and has sizes and parity bitmaps that allow a link), and is then verified on
the whole sets.

Pairs are named in two rounds. The first names, for each prefix token, the pairs
of its most typical owner with the others; the second names all pairs whose
classes are of different components by then, so no link between components is
lost, while a large group of copies doesn't cost the square of its size. Only
components are asked for, so links within one are not all named.

Defined results: a null, empty or wordless text has no shingles and is alone;
rows that share an id are compared as they are and share a component. A row with
a null id is in the component of the texts that equal its own, and else in none
(null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scan
from graphloom.llm.scan import Scratch, components

SIZE = 5


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for first, s in scan.slices(texts):
        low = scan.LOWER[s.data]
        starts, ends, doc = scan.runs(s, scan.NONSPACE)
        words = scan.span_hashes(low, starts, ends)
        edge = np.searchsorted(doc, np.arange(len(s) + 1))
        grams = scan.window_hashes(words, SIZE)
        for i in range(len(s)):
            a, b = int(edge[i]), int(edge[i + 1])
            yield first + i, np.unique(grams[a : b - SIZE + 1]) if b - a >= SIZE else scan.window_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _print(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(scan.mix(x)).view(np.int64)) if len(x) else 0, int(np.bitwise_xor.reduce(scan.mix(x + np.uint64(77))).view(np.int64)) if len(x) else 0


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(x), *_print(x)) for _, x in shingle_sets(batch.column(1))]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n", "f1", "f2"])


def _sample_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in shingle_sets(batch.column(1)):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["t"])


def frequent_tokens(named: DataFrame, classes: DataFrame, sample: int, share: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, counts) of the at most ``most`` tokens that ``share`` of ``sample`` classes hold.

    It only says which tokens are dealt by owner instead of by range, and their
    place in the order by frequency; what it misses goes by range.
    """
    few = classes.orderBy(F.xxhash64("f1"), "f1").limit(sample).select(F.col("rep").alias("doc_id"))
    rows = named.join(F.broadcast(few), "doc_id", "left_semi")
    found = rows.mapInArrow(_sample_tokens, "t bigint").groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") >= max(3, int(share * sample))).orderBy(F.desc("k"), "t").limit(most).toArrow()
    t = found["t"].to_numpy().view(np.uint64)
    order = np.argsort(t)
    return t[order], found["k"].to_numpy()[order].astype(np.int32)


def _at(heavy: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The index in ``heavy`` of each token, -1 for none."""
    if not len(heavy):
        return np.full(len(tokens), -1, np.int64)
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    return np.where(heavy[at] == tokens, at, -1)


def _postings(buckets: int, heavy: np.ndarray, flush: int = 600_000):
    """Batches of postings: for each token range, the tokens by owner, the owners, how many tokens each has there and in all.

    Frequent tokens go to ``buckets`` further ranges, by owner, so that none is gathered.
    """
    borders = np.array([i * (1 << 64) // buckets for i in range(1, buckets)], np.uint64)

    def made(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        owners = np.array(list(sets), np.int64)
        tokens = np.concatenate(list(sets.values()))
        own = np.repeat(np.arange(len(owners)), [len(x) for x in sets.values()])
        salt = (scan.mix(owners.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(_at(heavy, tokens) >= 0, buckets + salt[own], np.searchsorted(borders, tokens, side="right"))
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, own = bucket[order], tokens[order], own[order]
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        run_at = np.flatnonzero(new | np.concatenate([[True], own[1:] != own[:-1]]))
        run_owner, run_size = owners[own[run_at]], np.diff(np.append(run_at, len(own))).astype(np.uint32)
        run_n = np.array([len(x) for x in sets.values()], np.uint32)[own[run_at]]
        edge = np.flatnonzero(new)
        ends, run_edge = np.append(edge[1:], len(own)), np.searchsorted(run_at, np.append(edge, len(own)))
        out = [(int(bucket[i]), tokens[i:j].tobytes(), run_owner[x:y].tobytes(), run_size[x:y].tobytes(), run_n[x:y].tobytes()) for i, j, x, y in zip(edge.tolist(), ends.tolist(), run_edge[:-1].tolist(), run_edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "tokens", "owners", "sizes", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            held = 0
            for _, x in shingle_sets(batch.column(1)):
                if len(x) and sets.setdefault(_print(x)[0], x) is x:
                    held += len(x)
                if held >= flush:
                    yield made(sets)
                    sets, held = {}, 0
            if sets:
                yield made(sets)

    return run


def _runs(x: np.ndarray) -> np.ndarray:
    """The first index of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays that share its memory."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, ...]]]]:
    """(key, pieces of tokens, owners, sizes of runs, sizes of sets[, df]) of the rows of each key, which follow each other."""
    now, held = None, []
    for batch in batches:
        kinds = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32)
        columns = [_views(c, k) for c, k in zip(batch.columns[1:], kinds, strict=False)]
        for key, *piece in zip(batch.column(0).to_pylist(), *columns, strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(tuple(piece))
    if held:
        yield now, held


def _spread(pieces: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """tokens, owner, size of the owner's set[, df]: one value for each token."""
    return [np.concatenate(c) for c in zip(*((t, np.repeat(o, n), np.repeat(s, n), *more) for t, o, n, s, *more in pieces), strict=True)]


def _within(pieces: list[tuple[np.ndarray, ...]], low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What the pieces have of the tokens from ``low`` to below ``high``."""
    for t, o, n, s in pieces:
        at = np.flatnonzero((t >= np.uint64(low)) & (t <= np.uint64(high - 1)))
        if len(at):
            run = np.searchsorted(np.cumsum(n), at, side="right")
            yield t[at], o[run], np.ones(len(at), np.uint32), s[run]


def _shared(buckets: int, heavy: np.ndarray, counts: np.ndarray, classes: int, part: int = 500_000):
    """For each range of owners, the tokens of a token range that two classes or more have, with their df.

    A range is worked through in parts of about ``part`` tokens. The df of a
    frequent token is its count in the sample, put behind all others.
    """
    last = np.minimum(counts.astype(np.int64) + classes, (1 << 32) - 1).astype(np.uint32)

    def parts(key: int, pieces: list[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
        n = -(-sum(len(x[0]) for x in pieces) // part)
        low, high = (key * (1 << 64) // buckets, (key + 1) * (1 << 64) // buckets) if key < buckets else (0, 1 << 64)
        for i in range(n):
            own = list(_within(pieces, low + (high - low) * i // n, low + (high - low) * (i + 1) // n)) if n > 1 else pieces
            if own:
                yield _spread(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in _by_key(batches):
            for t, o, n in parts(key, pieces):
                order = np.lexsort((o, t))
                t, o, n = t[order], o[order], n[order]
                first = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])
                t, o, n = t[first], o[first], n[first]
                if key >= buckets:
                    df = last[_at(heavy, t)]
                else:
                    df = np.diff(np.append(at := _runs(t), len(t))).astype(np.uint32)
                    df = np.repeat(df, np.diff(np.append(at, len(t))))
                    t, o, n, df = t[df > 1], o[df > 1], n[df > 1], df[df > 1]
                to = (scan.mix(o.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((o, to))
                t, o, n, df, to = t[order], o[order], n[order], df[order], to[order]
                edge = _runs(to)
                out = []
                for i, j in zip(edge.tolist(), np.append(edge[1:], len(to)).tolist(), strict=False):
                    at = _runs(o[i:j])
                    out.append((int(to[i]), t[i:j].tobytes(), o[i:j][at].tobytes(), np.diff(np.append(at, j - i)).astype(np.uint32).tobytes(), n[i:j][at].tobytes(), df[i:j].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["part", "tokens", "owners", "sizes", "ns", "dfs"])

    return run


#: Longs of a set's parity bitmap: sets that differ in d tokens differ in d of its bits at most.
LONGS = 8
#: Smallest prefix tokens by which a pair is told to be named at another token already.
FEW = 32


def _indexed(percent: int, orders: int, step: int = 2000):
    """For each class with enough shared tokens: them, its prefix under each order (rising), its typicality and its bitmap."""
    schema = pa.schema([("f1", pa.int64()), ("n", pa.int64()), ("set", pa.list_(pa.int64())), *[(f"p{o}", pa.list_(pa.int64())) for o in range(orders)], ("typical", pa.float64()), *[(f"w{i}", pa.int64()) for i in range(LONGS)]])

    def made(t: np.ndarray, o: np.ndarray, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        at = _runs(o)
        size = np.diff(np.append(at, len(o)))
        who = np.repeat(np.arange(len(at)), size)
        cut = size - -(-n[at].astype(np.int64) * percent // 100) + 1
        rank = np.arange(len(o)) - at[who]
        cols = [pa.array(o[at]), pa.array(n[at].astype(np.int64)), scan.list_array(t.view(np.int64), size, pa.int64())]
        magnitude = np.log2(df).astype(np.uint8)
        for k in range(orders):
            order = np.lexsort((t, scan.mix(t + np.uint64(1 + k)), magnitude, who))[rank < cut[who]]
            prefix, own = t[order].view(np.int64), who[order]
            cols.append(scan.list_array(prefix[np.lexsort((prefix, own))], cut, pa.int64()))
        cols.append(pa.array(np.add.reduceat(df.astype(np.float64), at) / n[at]))
        bit = who * (64 * LONGS) + (scan.mix(t + np.uint64(1001)) % np.uint64(64 * LONGS)).astype(np.int64)
        odd = (np.bincount(bit, minlength=len(at) * 64 * LONGS) & 1).astype(np.uint8)
        words = np.packbits(odd.reshape(-1, 8), axis=1).reshape(len(at), -1).copy().view(np.int64)
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(LONGS)]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _by_key(batches):
            t, o, n, df = _spread(pieces)
            order = np.lexsort((t, o))
            t, o, n, df = t[order], o[order], n[order], df[order]
            size = np.diff(np.append(at := _runs(o), len(o)))
            live = np.repeat(size * 100 >= n[at].astype(np.int64) * percent, size)
            t, o, n, df = t[live], o[live], n[live], df[live]
            at = _runs(o)
            for k in range(0, len(at), step):
                i, j = int(at[k]), int(at[k + step]) if k + step < len(at) else len(o)
                yield made(t[i:j], o[i:j], n[i:j], df[i:j])

    columns = ["f1 bigint, n bigint, set array<bigint>", *[f"p{o} array<bigint>" for o in range(orders)], "typical double", *[f"w{i} bigint" for i in range(LONGS)]]
    return scan.tidy(run), ", ".join(columns)


class _Candidates:
    """Names pairs of indexed classes by the first order, and verifies those that every order and bound lets through."""

    def __init__(self, live: DataFrame, percent: int, orders: int):
        self.percent, self.orders = percent, orders
        words = [f"w{i}" for i in range(LONGS)]
        own = live.select("rep", "n", (F.col("n") - F.size("set")).alias("alone"), "set", *[f"p{o}" for o in range(1, orders)], *words)
        self.a, self.b = (own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns]) for side in "ab")
        self.words = words

    def may_link(self, a: str, b: str) -> Column:
        """Whether sizes and bitmaps allow a link; never false for one."""
        at = lambda side, name: F.col(f"{side}{name}")
        fits = (at(a, "n") * 100 >= at(b, "n") * self.percent) & (at(b, "n") * 100 >= at(a, "n") * self.percent)
        differ = sum((F.bit_count(at(a, w).bitwiseXOR(at(b, w))) for w in self.words), at(a, "alone") + at(b, "alone"))
        return fits & (differ * (100 + self.percent) <= (at(a, "n") + at(b, "n")) * (100 - self.percent))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) that the first order names, those that share a prefix token under each order."""
        both = pairs.join(self.b, F.col("b") == F.col("b_rep")).join(self.a, F.col("a") == F.col("a_rep"))
        passes = self.may_link("a_", "b_")
        for o in range(1, self.orders):
            passes &= F.arrays_overlap(f"a_p{o}", f"b_p{o}")
        return both.where(passes)

    def verified(self, pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("a_set", "b_set"))
        return self.filtered(pairs).where(both * 100 >= (F.col("a_n") + F.col("b_n") - both) * self.percent).select("a", "b")

    @staticmethod
    def by_heads(known: DataFrame) -> DataFrame:
        """Pairs of a prefix token's most typical owner with its owners of other components."""
        post = known.select(F.explode("p0").alias("t"), "rep", "comp", "typical")
        head = post.groupBy("t").agg(F.max(F.struct("typical", "rep", "comp")).alias("head"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
        pair = post.join(head.select("t", "head"), "t").where("comp <> head.comp")
        return pair.select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()

    def by_tokens(self, known: DataFrame) -> DataFrame:
        """All pairs of owners of a prefix token that are of different components; each at its smallest token, as a rule."""
        post = known.select(F.explode("p0").alias("t"), "rep", "comp")
        open_ = post.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("t")
        more = known.select("rep", "n", (F.col("n") - F.size("set")).alias("alone"), F.slice("p0", 1, FEW).alias("few"), *self.words)
        post = post.join(open_, "t").join(more, "rep")
        x, y = (post.select("t", *[F.col(c).alias(f"{side}{c}") for c in post.columns if c != "t"]) for side in "xy")
        told = F.coalesce(F.array_min(F.array_intersect("xfew", "yfew")) < F.col("t"), F.lit(False))
        pair = x.join(y, "t").where((F.col("xrep") < F.col("yrep")) & (F.col("xcomp") != F.col("ycomp")) & self.may_link("x", "y") & ~told)
        return pair.select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()


def near_classes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", percent: int = 75, orders: int = 3, range_tokens: int = 2_500_000, sample: int = 4000, share: float = 0.005, most: int = 100_000, trace: list | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    ``trace`` gets (round, pairs named, candidates, links) of each round.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sized = scratch.save(named.mapInArrow(scan.tidy(_sizes), "doc_id bigint, n bigint, f1 bigint, f2 bigint"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total // range_tokens) + 1)
    # A table of its own, so that the join of a large class with it is one that adaptive execution splits.
    classes = scratch.save(sized.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    heavy, counts = frequent_tokens(named, classes, sample, share, most)
    postings = named.mapInArrow(scan.tidy(_postings(buckets, heavy)), "bucket int, tokens binary, owners binary, sizes binary, ns binary")
    shared = postings.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(scan.tidy(_shared(buckets, heavy, counts, sized.count())), "part int, tokens binary, owners binary, sizes binary, ns binary, dfs binary")
    indexed = shared.repartition(2 * buckets, "part").sortWithinPartitions("part").mapInArrow(*_indexed(percent, orders))
    live = scratch.save(indexed.join(classes.where("rep IS NOT NULL").select("f1", "rep"), "f1"), batch_bytes=4 << 20)
    cand = _Candidates(live, percent, orders)
    links, known = None, live.withColumn("comp", F.col("rep"))
    for name, pairs in (("heads", cand.by_heads), ("all", cand.by_tokens)):
        own = scratch.save(pairs(known))
        more = scratch.save(cand.verified(own))
        if trace is not None:
            trace.append((name, own.count(), cand.filtered(own).count(), more.count()))
        links = more if links is None else links.unionByName(more)
        comp = components(links, scratch)
        if name != "all":
            known = live.join(comp, F.col("rep") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("id", "component")
    rep = sized.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
    out = rep.join(comp, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
