"""Session helpers: settings, the shared folder, and tables that cut lineage there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where it is unset (tests) a local one is made."""
    sc = spark.sparkContext
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kindred-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and stay compressed.

    ``keep(df)`` writes df and returns it as read again; ``drop(df)`` deletes a table that nothing needs any more. What is
    left goes when the driver process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
