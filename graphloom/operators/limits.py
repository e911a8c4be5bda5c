"""Bounds on what a query may take: time, rows and bytes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class TimedOut(TimeoutError):
    code = "DEADLINE_EXCEEDED"


class TooLarge(RuntimeError):
    code = "SNAPSHOT_BUDGET_EXCEEDED"


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """What ``work`` returns; its Spark jobs are cancelled, and TimedOut raised, when it takes longer."""
    tag, late = f"graphloom-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    if late.is_set():
        raise TimedOut(f"more than {seconds} s")
    return out


class Guard:
    """Counts rows and bytes of text of a frame while an action runs over ``rows``; ``check`` then raises or tells."""

    def __init__(self, rows: DataFrame, most_rows: int = 50_000, most_bytes: int = 8 << 20):
        self.most_rows, self.most_bytes, self.seen = most_rows, most_bytes, Observation()
        size = F.octet_length(F.to_json(F.struct("*"))) if rows.columns else F.lit(0)
        self.rows = rows.observe(self.seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))

    def check(self, degrade: bool = False) -> bool:
        """Whether the bounds held; if not, TooLarge unless ``degrade``."""
        got = self.seen.get
        ok = got["rows"] <= self.most_rows and (got["bytes"] or 0) <= self.most_bytes
        if not ok and not degrade:
            raise TooLarge(f"{got['rows']} rows of {got['bytes']} bytes")
        return ok
