"""Exact token counts of byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece there is one token that its encoding ends with; it
is the suffix token that can stand after the last token of the rest. Two tokens
can stand side by side if no merge across their border would have come before
the merges that made them; this is decided by undoing, the later first, the
merges at the border. The count of a prefix is one more than that of the rest,
so every prefix's count is stored and truncation needs no re-encoding.

A prefix that ends inside a piece counts the pieces before it and the part of
that piece. Defined results: a null text is an empty text of no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import scan
from graphloom.llm.bpe import KEPT, Vocabulary


class PrefixCounter:
    def __init__(self, vocab: Vocabulary, bound: int = 400_000):
        if vocab.word_end:
            raise ValueError("prefix counts are for byte-level vocabularies")
        self.vocab, self.bound = vocab, bound
        top = max(vocab.tokens) + 1
        self.rank = np.full(top, -1, np.int64)
        self.left = np.zeros(top, np.int64)
        self.right = np.zeros(top, np.int64)
        for (a, b), (rank, made) in vocab.merges.items():
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        special = set(vocab.special.values())
        words = {w: i for i, w in vocab.bytes.items() if i not in special}
        self.longest = max(map(len, words))
        self.by_bytes = words
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        h = scan.span_hashes(data, ends - sizes, ends)
        order = np.argsort(h)
        self.hashes, self.hash_ids = h[order], np.fromiter(words.values(), np.int64, len(words))[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True
        self.known: dict[str, int] = {}

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays a pair when their bytes are encoded together."""
        table = self.vocab.table
        out = np.zeros(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), 1 << 60, np.int64)
        while len(rows):
            at = table.find(a, b)
            crossing = np.where(at >= 0, table.ranks[at].astype(np.int64), 1 << 61)
            ra, rb = self.rank[a], self.rank[b]
            base = (ra < 0) & (rb < 0)
            good = crossing >= limit
            out[rows[good & base]] = True
            go = good & ~base
            rows, a, b, ra, rb = rows[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb  # of equal merges the left one came first, so the right one is undone
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def prefix_counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, offsets): counts[offsets[k] + i] is the count of the first i bytes of piece k."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)  # piece k starts at offsets[k]
        counts = np.zeros(int(offsets[-1]), np.int64)
        last = np.zeros(int(offsets[-1]), np.int64)
        order = np.argsort(-sizes, kind="stable")
        live = order
        for i in range(1, int(sizes.max(initial=0)) + 1):
            live = live[: np.searchsorted(-sizes[live], -i, side="right")]
            end = offsets[live] + i
            todo = np.arange(len(live))
            for size in range(min(i, self.longest), 0, -1):
                start = end[todo] - size
                token = self._tokens(data, start, end[todo])
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                if size < i:
                    hit = hit[self.adjacent(last[start[hit]], token[hit])]
                at = end[todo[hit]]
                last[at] = token[hit]
                counts[at] = counts[start[hit]] + 1
                rest = np.ones(len(todo), bool)
                rest[hit] = False
                todo = todo[rest]
                if not len(todo):
                    break
        return counts, offsets

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - one counter a worker
    def adjacent_one(self, a: int, b: int) -> bool:
        return bool(self.adjacent(np.array([a]), np.array([b]))[0])

    def long_counts(self, raw: bytes) -> np.ndarray:
        """The same counts for one long piece, prefix by prefix."""
        counts, last = [0], [0]
        for i in range(1, len(raw) + 1):
            for size in range(min(i, self.longest), 0, -1):
                token = self.by_bytes.get(raw[i - size : i])
                if token is not None and (size == i or self.adjacent_one(last[i - size], token)):
                    counts.append(counts[i - size] + 1)
                    last.append(token)
                    break
        return np.array(counts, np.int64)

    def _tokens(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if getattr(self, "_blocks", None) is None or self._blocks.data is not data:
            self._blocks = scan.Blocks(data)
        h = self._blocks.hashes(start, end)
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.seen[h >> np.uint64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            out[some] = np.where(self.hashes[at] == h[some], self.hash_ids[at], -1)
        return out

    def learn(self, chunks: set[str]) -> None:
        cut = [(c, [p.encode() for p in self.vocab.pieces(c)]) for c in chunks]
        distinct = sorted({p for _, own in cut for p in own}, key=len)
        n: dict[bytes, int] = {p: int(self.long_counts(p)[-1]) for p in distinct if len(p) > 64}
        distinct = distinct[: len(distinct) - len(n)]
        first = 0
        while first < len(distinct):
            stop, total = first, 0
            while stop < len(distinct) and (stop == first or total + len(distinct[stop]) < 300_000):
                total += len(distinct[stop])
                stop += 1
            part = distinct[first:stop]
            counts, offsets = self.prefix_counts(part)
            n.update(zip(part, counts[offsets[1:] - 1].tolist(), strict=True))
            first = stop
        self.known.update((c, sum(n[p] for p in own)) for c, own in cut)

    def count_all(self, texts: list[str | None]) -> Iterator[int]:
        split = []
        for t in texts:
            parts = self.vocab.parts(t or "")
            split.append((sum(isinstance(p, int) for p in parts), list(chain.from_iterable(self.vocab.chunks(p) for p in parts if not isinstance(p, int)))))
        new = {c for _, own in split for c in own if c not in self.known}
        if len(self.known) + len(new) > self.bound:
            self.known = {}
            new = {c for _, own in split for c in own}
        self.learn(new)
        for special, own in split:
            yield special + sum(map(self.known.__getitem__, own))
        for c in new:  # what is kept is bounded in bytes too
            if len(c) > KEPT:
                self.known.pop(c, None)

    def text_prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(byte offsets, counts): the count at every byte of the text, 0 first."""
        at, n, offs, out = 0, 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for part in self.vocab.parts(text):
            if isinstance(part, int):
                at, n = at + len(self.vocab.bytes[part]), n + 1
                offs.append(np.array([at]))
                out.append(np.array([n]))
                continue
            for p in self.vocab.pieces(part):
                raw = p.encode()
                counts = self.long_counts(raw)
                offs.append(at + np.arange(1, len(raw) + 1))
                out.append(n + counts[1:])
                at, n = at + len(raw), n + int(counts[-1])
        return np.concatenate(offs), np.concatenate(out)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix, on a character's border, within the budget."""
        offs, counts = self.text_prefixes(text)
        raw = text.encode()
        fits = np.flatnonzero(counts <= budget)
        at = int(offs[fits[-1]])
        while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return raw[:at].decode()


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def make():
        counter = PrefixCounter(Vocabulary.load(path))

        def work(texts: pa.Array) -> list:
            n = []
            sizes = []
            for k in range(0, len(texts), 500):
                part = texts.slice(k, 500).to_pylist()
                n.extend(counter.count_all(part))
                sizes.extend(len((t or "").encode()) for t in part)
            return [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

        return work

    return scan.append_columns(docs, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def truncate_tokens(docs: DataFrame, path: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with truncated: the longest prefix of each text, ending with a character, of at most ``budget`` tokens.

    A null text stays null.
    """

    def make():
        counter = PrefixCounter(Vocabulary.load(path))

        def work(texts: pa.Array) -> list:
            out: list[str | None] = []
            for k in range(0, len(texts), 500):
                part = texts.slice(k, 500).to_pylist()
                out += [t if t is None or n <= budget else counter.truncate(t, budget) for t, n in zip(part, counter.count_all(part), strict=True)]
            return [pa.array(out, pa.string())]

        return work

    return scan.append_columns(docs, text, "truncated string", make)


def prefix_counts_at(docs: DataFrame, path: str, every: int, text: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: array<bigint>, the exact counts of the prefixes of every, 2 * every, ... bytes (counted as bytes)."""

    def make():
        counter = PrefixCounter(Vocabulary.load(path))

        def work(texts: pa.Array) -> list:
            out = []
            for t in texts.to_pylist():
                offs, counts = counter.text_prefixes(t or "")
                wanted = np.arange(every, int(offs[-1]) + 1, every)
                out.append(counts[np.searchsorted(offs, wanted)].tolist())
            return [pa.array(out, pa.list_(pa.int64()))]

        return work

    return scan.append_columns(docs, text, "prefix_tokens array<bigint>", make)
