"""Typed filter building: ``Fields.age > 30`` makes the CEL text ``age > 30``.

Filters combine by ``&``, ``|`` and ``~``; literals are quoted, so a value can't
end its own string. The text goes wherever a CEL filter goes.
"""

from __future__ import annotations

import re


def quoted(value: object) -> str:
    """A CEL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return "'" + "".join(escapes.get(c, c) for c in str(value)) + "'"


class Filter(str):
    """CEL text that combines with more of it."""

    def __and__(self, other: str) -> Filter:
        return Filter(f"({self}) && ({other})")

    def __or__(self, other: str) -> Filter:
        return Filter(f"({self}) || ({other})")

    def __invert__(self) -> Filter:
        return Filter(f"!({self})")


class Field:
    def __init__(self, name: str):
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"no field name: {name!r}")
        self.name = name

    __hash__ = None

    def __eq__(self, value) -> Filter:
        return Filter(f"{self.name} == {quoted(value)}")

    def __ne__(self, value) -> Filter:
        return Filter(f"{self.name} != {quoted(value)}")

    def __lt__(self, value) -> Filter:
        return Filter(f"{self.name} < {quoted(value)}")

    def __le__(self, value) -> Filter:
        return Filter(f"{self.name} <= {quoted(value)}")

    def __gt__(self, value) -> Filter:
        return Filter(f"{self.name} > {quoted(value)}")

    def __ge__(self, value) -> Filter:
        return Filter(f"{self.name} >= {quoted(value)}")

    def isin(self, *values) -> Filter:
        return Filter(f"{self.name} in [{', '.join(map(quoted, values))}]")

    def between(self, low, high) -> Filter:
        return (self >= low) & (self <= high)

    def has(self) -> Filter:
        return Filter(f"has({self.name})")

    def contains(self, text: str) -> Filter:
        return Filter(f"{self.name}.contains({quoted(text)})")

    def startswith(self, text: str) -> Filter:
        return Filter(f"{self.name}.startsWith({quoted(text)})")

    def endswith(self, text: str) -> Filter:
        return Filter(f"{self.name}.endsWith({quoted(text)})")

    def allofterms(self, terms: str) -> Filter:
        return Filter(f"allofterms({self.name}, {quoted(terms)})")


class _Fields:
    def __getattr__(self, name: str) -> Field:
        return Field(name)


Fields = _Fields()


def with_params(text: str, params: dict[str, object]) -> str:
    """``$name`` outside of strings replaced by the quoted value; unknown names stay as they are."""
    out = []
    for m in re.finditer(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\$([A-Za-z_]\w*)|.""", text, re.S):
        out.append(quoted(params[m[1]]) if m[1] in params else m[0])
    return "".join(out)
