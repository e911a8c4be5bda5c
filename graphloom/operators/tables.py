"""Tables in the shared folder, to cut the lineage of plans that iterate."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a temporary folder in local mode (one for each
    application), and else a folder in the warehouse, which executors share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphloom-scratch"
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _local[app]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written and read again; ``drop`` removes a table that nothing reads any more, the rest go when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}", 0
        _made[self.base] = spark

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_graphloom_path", None):
            delete(self.spark, path)


@atexit.register
def _sweep() -> None:
    for base, spark in _made.items():
        try:
            delete(spark, base)
        except Exception:  # noqa: BLE001, S110 - the session may be gone already
            pass
