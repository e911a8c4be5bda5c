"""BPE encoding and decoding with public vocabularies.

The merges of one piece run over a segment tree: its leaves are the ranks of
adjacent pairs, each inner node the smaller of its two children (the left one
on ties), so the root is the leftmost pair of the lowest rank. A merge updates
two neighbouring leaves and clears one, each in logarithmic time, until the
root holds no mergeable pair; n symbols take O(n log n).

Text is normalised and cut as the vocabulary file says, for the two kinds of
file that ``Vocabulary.load`` accepts (byte-level, and lower-cased with word
ends). Special strings inside texts become their ids. White-space-delimited
chunks are encoded once and remembered, up to a bound.

Defined results: a null text is an empty text; no ids decode to an empty text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

NONE = 1 << 60


def byte_letters() -> list[str]:
    """Fixed values, by their rule: the letter that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = [""] * 256
    for b in printable:
        letters[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[b] = chr(256 + k)
    return letters


LETTERS = byte_letters()


class RankTree:
    """A segment tree of (rank, position) minima over the pairs of a piece."""

    def __init__(self, ranks: list[int]):
        self.width = 1
        while self.width < len(ranks):
            self.width *= 2
        leaves = ranks + [NONE] * (self.width - len(ranks))
        self.best = [0] * self.width + list(range(self.width))  # position of the minimum under each node
        self.rank = leaves
        for node in range(self.width - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        left, right = self.best[2 * node], self.best[2 * node + 1]
        self.best[node] = left if self.rank[left] <= self.rank[right] else right

    def root(self) -> tuple[int, int]:
        at = self.best[1]
        return self.rank[at], at

    def put(self, at: int, rank: int) -> None:
        self.rank[at] = rank
        node = (self.width + at) >> 1
        while node:
            self._pull(node)
            node >>= 1


def merge_piece(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids that remain when the merges (pair to (rank, id)) are done on the symbols."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols)
    get = merges.get
    pair = [get((ids[i], ids[i + 1])) for i in range(n - 1)]
    tree = RankTree([p[0] if p else NONE for p in pair])
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    while True:
        rank, at = tree.root()
        if rank == NONE:
            return [x for x, on in zip(ids, alive, strict=True) if on]
        other = right[at]
        ids[at] = get((ids[at], ids[other]))[1]
        alive[other] = False
        right[at] = after = right[other]
        if after < n:
            left[after] = at
            p = get((ids[at], ids[after]))
            tree.put(at, p[0] if p else NONE)
        else:
            tree.put(at, NONE)
        if other < n - 1:
            tree.put(other, NONE)
        if (before := left[at]) >= 0:
            p = get((ids[before], ids[at]))
            tree.put(before, p[0] if p else NONE)


class PairTable:
    """The merges as arrays, found by an open hash of (left id, right id)."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.keys = np.array([a << 20 | b for a, b in merges], np.int64)
        self.ranks = np.array([r for r, _ in merges.values()], np.int32)
        self.made = np.array([i for _, i in merges.values()], np.int32)
        bits = max(10, (len(self.keys) * 32).bit_length())
        self.shift, self.factor = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        self.slot = np.full((1 << bits) + len(self.keys), -1, np.int32)
        self.probes = 1
        taken: dict[int, int] = {}
        for i, home in enumerate(self._home(self.keys).tolist()):
            at = home
            while at in taken:
                at += 1
            taken[at] = i
            self.probes = max(self.probes, at - home + 1)
        self.slot[list(taken)] = list(taken.values())

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, or -1."""
        keys = a.astype(np.int64) << 20 | b
        home = self._home(keys)
        at = self.slot[home]
        for k in range(1, self.probes):
            miss = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
            if not len(miss):
                return at
            at[miss] = self.slot[home[miss] + k]
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)


#: Pieces of up to so many symbols go through trees side by side, one row each.
WIDEST = 64


def merge_rows(ids: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merges of many pieces at once: one segment tree a row, all updated in step.

    ``ids``: one piece a row, ``width`` (a power of two) columns. Returns the
    ids and which of them remain.
    """
    n, width = ids.shape
    ids = ids.copy()
    cols = np.arange(width)
    alive = cols < sizes[:, None]
    left = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int16), (n, width)).copy()
    right = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), (n, width)).copy()
    never = np.int64(NONE)
    tree = np.full((n, 2 * width), never)  # a node holds rank * width + position of the smallest below it

    def leaf(found: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(found >= 0, table.ranks[found].astype(np.int64) * width + at, never)

    r, c = np.nonzero(alive[:, 1:])
    tree[r, width + c] = leaf(table.find(ids[r, c], ids[r, c + 1]), c)
    for level in (width >> k for k in range(1, width.bit_length())):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = width + at
        tree[rows, node] = values
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < never)
    while len(rows):
        at = tree[rows, 1] % width
        other = right[rows, at].astype(np.int64)
        ids[rows, at] = table.made[table.find(ids[rows, at], ids[rows, other])]
        alive[rows, other] = False
        after = right[rows, other].astype(np.int64)
        right[rows, at] = after
        put(rows, other, np.full(len(rows), never))
        more = after < sizes[rows]
        values = np.full(len(rows), never)
        ra, aa, na = rows[more], at[more], after[more]
        left[ra, na] = aa
        values[more] = leaf(table.find(ids[ra, aa], ids[ra, na]), aa)
        put(rows, at, values)
        before = left[rows, at].astype(np.int64)
        some = before >= 0
        if some.any():
            rb, ab, bb = rows[some], at[some], before[some]
            put(rb, bb, leaf(table.find(ids[rb, bb], ids[rb, ab]), bb))
        rows = rows[tree[rows, 1] < never]
    return ids, alive


#: White space of the vocabulary files' patterns, as the inside of a character class.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that str.split() drops though the patterns take them for text.
_ODD = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(f"[{SPACES}]+")


#: Longer chunks are encoded anew each time.
KEPT = 64


class Vocabulary:
    """One vocabulary file. ``word_end``: lower-cased words with a word end; else byte-level with leading spaces."""

    def __init__(self, spec: dict, cache: int = 250_000):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a kind of vocabulary that is known here")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.letter = [self.ids.get(x) for x in LETTERS]
        self.last = [self.ids.get(x + self.word_end) for x in LETTERS]
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        if self.word_end:
            pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.piece = regex.compile(pattern)
        else:
            # fixed values: the split of the public byte-level format
            self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.chunk = regex.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bound = cache
        self.known: dict[str, tuple[int, ...]] = {}
        self._table: PairTable | None = None
        letters = {x: b for b, x in enumerate(LETTERS)}
        self.bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for i, t in self.tokens.items()}

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of text, by the merges over the tree."""
        symbols = [self.letter[b] for b in raw]
        if self.word_end:
            symbols[-1] = self.last[raw[-1]]
        return merge_piece(symbols, self.merges)

    def pieces(self, chunk: str) -> list[str]:
        return self.piece.findall(chunk)

    @property
    def table(self) -> PairTable:
        if self._table is None:
            self._table = PairTable(self.merges)
        return self._table

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; short ones side by side, long ones with a tree of their own."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        letter = np.array([-1 if x is None else x for x in self.letter], np.int32)
        last = np.array([-1 if x is None else x for x in self.last], np.int32)
        for i in np.flatnonzero(sizes > WIDEST).tolist():
            out[i] = self.encode_piece(pieces[i])
        low = 0
        for width in (4, 8, 16, 32, WIDEST):
            these = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(these, max(1, len(these) * width // (1 << 19) + 1)):
                if not len(part):
                    continue
                raw = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
                own = sizes[part]
                ids = np.zeros((len(part), width), np.int32)
                inside = np.arange(width) < own[:, None]
                ids[inside] = letter[raw]
                ends = np.cumsum(own) - 1
                ids[np.arange(len(part)), own - 1] = last[raw[ends]]
                ids, alive = merge_rows(ids, own, self.table)
                flat, counts = ids[alive].tolist(), alive.sum(1)
                stops = np.cumsum(counts).tolist()
                at = 0
                for i, stop in zip(part.tolist(), stops, strict=True):
                    out[i] = flat[at:stop]
                    at = stop
        return out

    def encode_chunks(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each chunk that isn't known yet; each distinct piece is merged once."""
        cut = [(c, [p.encode() for p in self.pieces(c)]) for c in chunks]
        distinct = list({p for _, own in cut for p in own})
        done = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return {c: tuple(done[own[0]]) if len(own) == 1 else tuple(i for p in own for i in done[p]) for c, own in cut}

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """As encode(), for many texts: their new chunks are merged together."""
        get = self.known.get
        split: list[list[list[str] | int]] = []
        new: set[str] = set()
        for t in texts:
            own: list[list[str] | int] = []
            for part in self.parts(t or ""):
                if isinstance(part, int):
                    own.append(part)
                else:
                    words = self.chunks(self.normalise(part))
                    new.update(w for w in set(words) if w not in self.known)
                    own.append(words)
            split.append(own)
        if len(self.known) + len(new) > self.bound:
            keep = self.known if len(self.known) < self.bound else {}
            self.known = {w: keep[w] for own in split for part in own if not isinstance(part, int) for w in part if w in keep}
            new.update(w for own in split for part in own if not isinstance(part, int) for w in part if w not in self.known)
        self.known.update(self.encode_chunks(new))
        get = self.known.__getitem__
        for own in split:
            out: list[int] = []
            for part in own:
                if isinstance(part, int):
                    out.append(part)
                else:
                    out.extend(chain.from_iterable(map(get, part)))
            yield out
        for w in new:  # what is kept is bounded in bytes too
            if len(w) > KEPT:
                self.known.pop(w, None)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        out = self.known.get(chunk)
        if out is None:
            out = tuple(i for p in self.pieces(chunk) for i in self.encode_piece(p.encode()))
            if len(chunk) <= KEPT:
                if len(self.known) >= self.bound:
                    self.known.clear()
                self.known[chunk] = out
        return out

    def normalise(self, text: str) -> str:
        if not self.word_end:
            return text
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # letter by letter: no rule that looks at neighbours, as for a final sigma
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str]:
        """Parts of normalised text that can be encoded on their own, one after the other."""
        if self.word_end:
            return text.split() if not _ODD.search(text) else [x for x in _SPLIT.split(text) if x]
        return self.chunk.findall(text)

    def parts(self, text: str) -> list[str | int]:
        """Ordinary text and the ids of special strings, in order."""
        if not self.cut or not any(s in text for s in self.special):
            return [text] if text else []
        return [self.special.get(x, x) for x in self.cut.split(text) if x]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, slow = self.known.get, self.encode_chunk
        for part in self.parts(text or ""):
            if isinstance(part, int):
                out.append(part)
                continue
            for c in self.chunks(self.normalise(part)):
                out.extend(get(c) or slow(c))
        return out

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        """Byte-level: the text of the tokens' bytes. With word ends: the tokens joined by a space, as the file names no decoder."""
        if skip_special:
            special = set(self.special.values())
            ids = [i for i in ids if i not in special]
        if self.word_end:
            return " ".join(map(self.tokens.__getitem__, ids))
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_words(self, ids: list[int]) -> str:
        """With word ends: the words that the tokens spell, a space after each."""
        joined = "".join(map(self.tokens.__getitem__, ids)).replace(self.word_end, " ")
        raw = bytearray()
        back = {x: b for b, x in enumerate(LETTERS)}
        for c in joined:
            raw += bytes([back[c]]) if c in back else c.encode()
        return raw.decode("utf-8", "replace").rstrip(" ")
