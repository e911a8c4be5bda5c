"""CEL filters compiled to Spark columns.

Null semantics are SQL's: a predicate that isn't true drops the row. What is an
error in CEL is null here, so no row ends the query and ``!`` doesn't turn an
error into a match: comparing types that don't fit, calling a function on a type
it isn't for, integer overflow, division by zero, a pattern that doesn't
compile, and an undeclared name (which in node filters is null, so that
``x == null`` holds, and in edge filters an error). A timestamp column meets
integer literals as microseconds: the literal is rewritten, so the filter still
reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CelSyntaxError(ValueError):
    code = "ERR_VALIDATION_CEL_SYNTAX"


class CelTypeError(ValueError):
    code = "ERR_VALIDATION_CEL_TYPE"


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>()?:,.\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


@dataclass
class Typed:
    """A column with its CEL type: bool, int, double, string, timestamp, bytes, null, list or error."""

    col: Column | None
    kind: str
    literal: object = None
    items: list | None = None


NOTHING = "error"


def _error(kind: str = NOTHING) -> Typed:
    """What a CEL error becomes: null, which no filter keeps and no negation turns into a match."""
    return Typed(F.lit(None).cast({"int": "bigint", NOTHING: "boolean"}.get(kind, kind if kind in ("double", "string") else "boolean")), kind)


def _compiles(pattern: str) -> bool:
    """Whether the JVM's regular expressions take the pattern."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType):
        return "double"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz" if isinstance(t, T.TimestampNTZType) else "timestamp"
    return "bytes" if isinstance(t, T.BinaryType) else "string"


class _Parser:
    def __init__(self, text: str, schema: T.StructType, undefined_false: bool):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise CelSyntaxError(f"unexpected character at {at}: {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.fields, self.loose = 0, {f.name: f.dataType for f in schema}, undefined_false

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CelSyntaxError(f"expected {op!r}")

    def expression(self) -> Typed:
        cond = self.either()
        if self.take("?"):
            a = self.expression()
            self.need(":")
            b = self.expression()
            test = self.bool(cond)
            kinds = {a.kind, b.kind} - {"null", NOTHING}
            if len(kinds) > 1 and kinds != {"int", "double"}:
                raise CelTypeError(f"the branches are {a.kind} and {b.kind}")
            return Typed(F.when(test, a.col).when(~test, b.col), "double" if len(kinds) > 1 else next(iter(kinds), a.kind))
        return cond

    def either(self) -> Typed:
        out = self.both()
        while self.take("||"):
            out = Typed(self.bool(out) | self.bool(self.both()), "bool")
        return out

    def both(self) -> Typed:
        out = self.relation()
        while self.take("&&"):
            out = Typed(self.bool(out) & self.bool(self.relation()), "bool")
        return out

    def bool(self, x: Typed) -> Column:
        if x.kind in ("null", NOTHING):
            return F.lit(None).cast("boolean")
        if x.kind != "bool":
            raise CelTypeError(f"a boolean is needed, not {x.kind}")
        return x.col

    def relation(self) -> Typed:
        out = self.sum()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            out = self.member(out, self.sum()) if op == "in" else self.compare(op, out, self.sum())
        return out

    def member(self, x: Typed, xs: Typed) -> Typed:
        if xs.items is None:
            raise CelTypeError("in needs a list")
        hits = [self.compare("==", x, y).col for y in xs.items]
        out = F.lit(False)
        for h in hits:
            out = out | h
        return Typed(x.col.isin([y.literal for y in xs.items]) if xs.items and all(y.literal is not None and y.kind == x.kind for y in xs.items) else out, "bool")

    def compare(self, op: str, a: Typed, b: Typed) -> Typed:
        if NOTHING in (a.kind, b.kind) or "list" in (a.kind, b.kind):
            return _error("bool")
        if "null" in (a.kind, b.kind):
            other = a if b.kind == "null" else b
            if op not in ("==", "!="):
                return _error("bool")
            if other.kind == "null":
                return Typed(F.lit(op == "=="), "bool")
            return Typed(other.col.isNull() if op == "==" else other.col.isNotNull(), "bool")
        a, b = self.stamp(a, b), self.stamp(b, a)
        number = {"int", "double"}
        if a.kind != b.kind and not {a.kind, b.kind} <= number:
            return _error("bool")
        x, y = a.col, b.col
        return Typed({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")

    @staticmethod
    def stamp(a: Typed, other: Typed) -> Typed:
        if other.kind.startswith("timestamp") and a.kind == "int" and a.literal is not None:
            return Typed(F.timestamp_micros(F.lit(a.literal)).cast(other.kind), other.kind, a.literal)
        return a

    def sum(self) -> Typed:
        out = self.product()
        while op := self.take("+", "-"):
            b = self.product()
            if op == "+" and out.kind == b.kind == "string":
                out = Typed(F.concat(out.col, b.col), "string")
            else:
                out = self.arithmetic(op, out, b)
        return out

    def product(self) -> Typed:
        out = self.unary()
        while op := self.take("*", "/", "%"):
            out = self.arithmetic(op, out, self.unary())
        return out

    def number(self, a: Typed, b: Typed) -> str:
        if not {a.kind, b.kind} <= {"int", "double", "null", NOTHING}:
            raise CelTypeError(f"no arithmetic on {a.kind} and {b.kind}")
        if {a.kind, b.kind} & {"null", NOTHING}:
            return NOTHING
        return "double" if "double" in (a.kind, b.kind) else "int"

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        """64-bit integers whose overflow is null, or doubles, whose division by zero has a result."""
        kind = self.number(a, b)
        if kind == NOTHING or (kind == "double" and op == "%"):
            return _error()
        x, y = (c.col.cast("bigint" if kind == "int" else "double") for c in (a, b))
        if kind == "double":
            over = F.when(y == 0, x * F.lit(float("inf"))).otherwise(x / F.when(y != 0, y))
            return Typed({"+": x + y, "-": x - y, "*": x * y}[op] if op != "/" else over, "double")
        if op == "/":
            return Typed(F.when(y == -1, F.try_subtract(F.lit(0).cast("bigint"), x)).otherwise(F.call_function("div", x, F.when(~y.isin(0, -1), y))), "int")
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](x, y), "int")

    def unary(self) -> Typed:
        if self.take("!"):
            return Typed(~self.bool(self.unary()), "bool")
        if self.take("-"):
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "num":
                x = self.literal("-" + self.tokens[self.at][1])
                self.at += 1
                return x
            x = self.unary()
            if self.number(x, x) == NOTHING:
                return _error()
            return Typed(F.try_subtract(F.lit(0).cast("bigint"), x.col.cast("bigint")) if x.kind == "int" else -x.col, x.kind)
        return self.postfix()

    @staticmethod
    def literal(text: str) -> Typed:
        if re.search("[.eE]", text):
            return Typed(F.lit(float(text)), "double", float(text))
        if not -(1 << 63) <= int(text) < 1 << 63:
            raise CelSyntaxError(f"{text} is no 64-bit integer")
        return Typed(F.lit(int(text)), "int", int(text))

    def postfix(self) -> Typed:
        out = self.primary()
        while self.take("."):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else None
            self.at += 1
            out = self.call(name, [out, *self.arguments()])
        return out

    def arguments(self) -> list[Typed]:
        self.need("(")
        out: list[Typed] = []
        while not self.take(")"):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def call(self, name: str | None, args: list[Typed]) -> Typed:
        c = [a.col for a in args]
        text = all(a.kind == "string" for a in args)
        two = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}
        if name in two and len(args) == 2:
            return Typed(two[name](*c), "bool") if text else _error("bool")
        if name == "matches" and len(args) == 2:
            if not text or args[1].literal is None or not _compiles(args[1].literal):
                return _error("bool")
            return Typed(F.regexp_like(*c), "bool")
        if name == "size" and len(args) == 1:
            if args[0].kind == "list":
                return Typed(F.lit(len(args[0].items)), "int", len(args[0].items))
            return Typed(F.length(c[0]).cast("bigint"), "int") if args[0].kind in ("string", "bytes") else _error("int")
        if name == "has" and len(args) == 1:
            return Typed(F.lit(False) if args[0].kind in ("null", NOTHING) else c[0].isNotNull(), "bool")
        casts = {"int": ("bigint", "int"), "double": ("double", "double"), "string": ("string", "string"), "bool": ("boolean", "bool")}
        if name in casts and len(args) == 1 and args[0].kind in ("list", NOTHING):
            return _error(casts[name][1])
        if name in casts and len(args) == 1:
            return Typed(c[0].try_cast(casts[name][0]), casts[name][1])
        if name == "allofterms" and len(args) == 2 and not text:
            return _error("bool")
        if name == "allofterms" and len(args) == 2:
            tokens = lambda x: F.array_remove(F.split(F.lower(x), r"\s+"), "")
            return Typed(F.size(F.array_except(tokens(c[1]), tokens(c[0]))) == 0, "bool")
        raise CelSyntaxError(f"no function {name!r} of {len(args)} arguments")

    def primary(self) -> Typed:
        if self.at >= len(self.tokens):
            raise CelSyntaxError("unexpected end")
        group, tok = self.tokens[self.at]
        self.at += 1
        if group == "num":
            return self.literal(tok)
        if group == "str":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), tok[1:-1])
            return Typed(F.lit(value), "string", value)
        if group == "id":
            if tok in ("true", "false"):
                return Typed(F.lit(tok == "true"), "bool", tok == "true")
            if tok == "null":
                return Typed(F.lit(None), "null")
            if self.peek() == "(":
                return self.call(tok, self.arguments())
            if tok in self.fields:
                return Typed(F.col(f"`{tok}`"), _kind(self.fields[tok]))
            return _error() if self.loose else Typed(F.lit(None), "null")
        if tok == "(":
            out = self.expression()
            self.need(")")
            return out
        if tok == "[":
            items: list[Typed] = []
            while not self.take("]"):
                if items:
                    self.need(",")
                items.append(self.expression())
            return Typed(None, "list", items=items)
        raise CelSyntaxError(f"unexpected {tok!r}")


def compile_cel(text: str, schema: T.StructType, undefined_false: bool = False) -> Column:
    """The filter as a boolean column over ``schema``; an empty filter keeps all rows."""
    if not text.strip():
        return F.lit(True)
    p = _Parser(text, schema, undefined_false)
    out = p.expression()
    if p.at != len(p.tokens):
        raise CelSyntaxError(f"unexpected {p.tokens[p.at][1]!r}")
    return p.bool(out)
