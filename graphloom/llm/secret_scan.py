"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksums.

Offsets are code points, ends exclusive. ``assign``, ``access`` and ``hex`` are
the base kinds, leftmost and non-overlapping within a kind; a match that is too
short is dropped but still uses up its characters. Further kinds need a valid
checksum or header: ``github`` and ``npm`` (CRC-32 in base 62), ``jwt`` (a JSON
header with "alg"), ``pem`` (a private-key block's first line).

Each character is read a bounded number of times for each kind, whatever the
text: a run that fails as a ``jwt`` isn't begun again within itself.

Null or empty texts have no spans. Rows are independent, so repeated rows give
repeated results. Input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import scan

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_GITHUB = re.compile("gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile("[A-Za-z0-9_-]*")
_PEM = re.compile("-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: keyword (lower case) to kind
_WORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _checksum(body: str) -> str:
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):  # RecursionError: brackets nested without end
        return False


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "github": (_GITHUB, lambda m: _checksum(m[0][4:-6]) == m[0][-6:]),
    "npm": (_NPM, lambda m: _checksum(m[0][4:-6]) == m[0][-6:]),
    "jwt": (_JWT, lambda m: _header(m[1])),
    "pem": (_PEM, lambda m: True),
}


class Scanner:
    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for w, kind in _WORDS.items():
            self.words.add_word(w, (len(w), kind))
        self.words.make_automaton()

    def slice_spans(self, s: scan.Slice) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(s))]
        hits: dict[int, list[tuple[int, str]]] = {}
        low = scan.LOWER[s.data].tobytes().decode("latin-1")  # one character a byte
        bounds = s.bounds
        for end, (n, kind) in self.words.iter(low):
            start = end - n + 1
            i = int(np.searchsorted(bounds, start, side="right")) - 1
            if end < bounds[i + 1]:
                hits.setdefault(i, []).append((start - int(bounds[i]), kind))
        starts, ends, doc = scan.runs(s, _HEX)
        for k in np.flatnonzero(ends - starts >= 16).tolist():
            i = int(doc[k])
            out[i].append((int(starts[k] - bounds[i]), int(ends[k] - bounds[i]), "hex"))
        for i in {*hits, *(i for i, x in enumerate(out) if x)}:
            raw = s.data[bounds[i] : bounds[i + 1]].tobytes()
            text = raw.decode("latin-1")
            past: dict[str, int] = {}
            for at, kind in sorted(hits.get(i, ())):
                if at < past.get(kind, 0):
                    continue
                rule, valid = _RULES[kind]
                if m := rule.match(text, at):
                    past[kind] = m.end()
                    if valid(m):
                        out[i].append((m.start(), m.end(), kind))
                elif kind == "jwt":  # what stops this run stops every later one that begins in it
                    past[kind] = _JWT_RUN.match(text, at).end()
            if not raw.isascii():  # bytes to code points
                lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                out[i] = [(int(lead[a]), int(lead[b]), k) for a, b, k in out[i]]
            out[i].sort(key=lambda x: (x[0], KINDS.index(x[2])))
        return out


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets: array<struct<kind, start, end>> by start, then kind as in KINDS."""

    def make():
        scanner = Scanner()

        def work(texts: pa.Array) -> list:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in own] for _, s in scan.slices(texts) for own in scanner.slice_spans(s)]
            return [pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

        return work

    return scan.append_columns(docs, text, "secrets array<struct<kind: string, start: bigint, end: bigint>>", make)
