"""Node scans: filter, project, page; lookups; set algebra on node identity."""

from __future__ import annotations

import json
import struct
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.cel import compile_cel

DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000


def after_key(keys: list[str], values: tuple, nodes: DataFrame) -> Column:
    """Rows behind a key in lexicographic order, led by a comparison of the first column, which scans can use."""
    lits = [F.lit(v).cast(nodes.schema[c].dataType) for c, v in zip(keys, values, strict=True)]
    if len(keys) == 1:
        return F.col(keys[0]) > lits[0]
    behind, equal = F.lit(False), F.lit(True)
    for c, v in zip(keys, lits, strict=True):
        behind |= equal & (F.col(c) > v)
        equal &= F.col(c) == v
    return (F.col(keys[0]) >= lits[0]) & behind


def _bounded(limit: int) -> int:
    if limit > MAX_LIMIT:
        warnings.warn(f"a page holds {MAX_LIMIT} rows at most, not {limit}", stacklevel=3)
    return min(limit, MAX_LIMIT)


def find(nodes: DataFrame, cel: str = "", fields: list[str] | None = None, order: list[str] | None = None, limit: int | None = DEFAULT_LIMIT, offset: int = 0, after: tuple | None = None, system: tuple[str, ...] = (), limit_first: bool = False) -> DataFrame:
    """Rows that the filter keeps, in the given order, after a keyset cursor, then offset and limit.

    ``system`` columns are always kept; unknown names in ``fields`` are dropped.
    With ``limit`` None the whole result is returned, unordered; a limit above
    MAX_LIMIT is cut to it, with a warning. ``limit_first`` takes the limit
    before the offset, so that limit - offset rows are left.
    """
    out = nodes.where(compile_cel(cel, nodes.schema))
    if after is not None:
        out = out.where(after_key(order, after, nodes))
    if limit is not None:
        out = out.orderBy(*order) if order else out
        n = _bounded(limit)
        out = out.limit(n).offset(offset) if limit_first else out.offset(offset).limit(n)
    if fields is not None:
        out = out.select(*system, *[c for c in fields if c in nodes.columns and c not in system])
    return out


class UnknownField(ValueError):
    code = "ERR_VALIDATION_UNKNOWN_FIELD"


def select_fields(nodes: DataFrame, fields: list[str], key: str | None = None) -> DataFrame:
    """The fields, of which each must exist; ``uid`` is the id."""
    if unknown := [f for f in fields if f not in nodes.columns and not (f == "uid" and key)]:
        raise UnknownField(f"no such fields: {', '.join(unknown)}")
    return nodes.select(*[F.col(key).alias("uid") if f == "uid" and f not in nodes.columns else F.col(f) for f in fields])


def quick_filter(prop: str, op: str, value: object) -> Column:
    """One comparison; a null property matches ``== null`` alone."""
    c = F.col(prop)
    if value is None:
        return c.isNull() if op == "==" else c.isNotNull() if op == "!=" else F.lit(False)
    v = F.lit(value)
    return F.coalesce({"==": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op], F.lit(False))


def get(nodes: DataFrame, **key: object) -> DataFrame:
    """Point lookup: the node with all parts of the key, or none."""
    return nodes.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in key.items()]))


def lookup(nodes: DataFrame, ids: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """Batch lookup: (pos, id) left-joined to the nodes, so a missing id has null columns; ``ordered`` by pos."""
    out = ids.join(nodes.withColumn("__k", F.col(key)), F.col("id") == F.col("__k"), "left").drop("__k")
    return out.orderBy("pos") if ordered else out


def scan_range(nodes: DataFrame, prop: str, key: list[str], lower: object = None, upper: object = None, closed: tuple[bool, bool] = (True, False), limit: int | None = None) -> DataFrame:
    """Nodes whose property lies between the bounds (None: open), by value, then key."""
    out = nodes.where(F.col(prop).isNotNull())
    if lower is not None:
        out = out.where(F.col(prop) >= F.lit(lower) if closed[0] else F.col(prop) > F.lit(lower))
    if upper is not None:
        out = out.where(F.col(prop) <= F.lit(upper) if closed[1] else F.col(prop) < F.lit(upper))
    out = out.orderBy(prop, *key)
    return out if limit is None else out.limit(limit)


@dataclass
class Page:
    rows: DataFrame
    has_more: bool
    cursor: bytes | None


def keyset_cursor(values: tuple) -> bytes:
    return b"\x01" + json.dumps(list(values)).encode()


def offset_cursor(offset: int) -> bytes:
    return struct.pack(">q", offset)


def read_cursor(cursor: bytes) -> tuple[tuple | None, int]:
    """(key, offset) of a cursor of either kind."""
    if cursor[:1] == b"\x01":
        return tuple(json.loads(cursor[1:])), 0
    if len(cursor) != 8:
        raise ValueError("no cursor")
    return None, struct.unpack(">q", cursor)[0]


def page(nodes: DataFrame, key: list[str], cel: str = "", fields: list[str] | None = None, size: int = DEFAULT_LIMIT, cursor: bytes | None = None) -> Page:
    """A page in key order, whether there are more, and the cursor of its last row.

    Keys of ``size`` + 1 rows come to the driver; ``size`` is MAX_LIMIT at most.
    """
    size = _bounded(size)
    after, offset = read_cursor(cursor) if cursor else (None, 0)
    keys = nodes.where(compile_cel(cel, nodes.schema))
    keys = keys.where(after_key(key, after, nodes)) if after is not None else keys
    ahead = keys.select(*key).orderBy(*key).offset(offset).limit(size + 1).collect()
    rows = find(nodes, cel, fields, key, size, offset, after, tuple(key))
    more = len(ahead) > size
    return Page(rows, more, keyset_cursor(tuple(ahead[size - 1])) if more else None)


def union(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Nodes of any set; of equal keys, the row of the earliest set."""
    numbered = [s.withColumn("__set", F.lit(i)) for i, s in enumerate(sets)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in both.columns if c not in (*keys, "__set")]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), "__set").alias("__row"))
    return first.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def intersect(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*keys), keys, "left_semi"), sets)


def difference(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*keys), keys, "left_anti"), sets)


def postings(nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, value, key) for each non-null value: the term index as a table."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return nodes.select(F.explode(pairs).alias("x"), F.col(key)).where("x.value IS NOT NULL").select("x.field", "x.value", key)


def by_terms(index: DataFrame, key: str, groups: list[list[tuple[str, str]]]) -> DataFrame:
    """Keys with all terms of any group (an OR of ANDs), from one pass over the postings."""
    hit = lambda f, v: F.max((F.col("field") == f) & (F.col("value") == v))
    terms = sorted({t for g in groups for t in g})
    wanted = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("value") == v) for f, v in terms])
    found = index.where(wanted).groupBy(key).agg(*[hit(f, v).alias(f"t{i}") for i, (f, v) in enumerate(terms)])
    has = [reduce(lambda a, b: a & b, [F.col(f"t{terms.index(t)}") for t in g]) for g in groups]
    return found.where(reduce(lambda a, b: a | b, has)).select(key)


def composite_term(fields: list[str]) -> Column:
    """Several properties as one term, null if any is: equal only where all are, whatever the values hold."""
    parts = [F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")) for f in fields]
    return F.concat(*parts)
