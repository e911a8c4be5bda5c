"""Results as text: a table to look at, or JSON lines and CSV files that hold nested columns too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, bytes as base64, so that any text format takes them."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(f.name)
        return F.base64(c).alias(f.name) if isinstance(f.dataType, T.BinaryType) else c

    return rows.select(*map(one, rows.schema.fields))


def save(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header line, a file for each partition."""
    if kind == "json":
        rows.write.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        flat(rows).write.option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"no format {kind!r}")


def table(rows: DataFrame, limit: int = 20) -> str:
    """The first rows, in columns as wide as what they hold."""
    got = [tuple("" if v is None else str(v) for v in r) for r in flat(rows).limit(limit).collect()]
    wide = [max(map(len, col)) for col in zip(rows.columns, *got, strict=True)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([line(rows.columns), "-+-".join("-" * w for w in wide), *map(line, got)])
