"""Intermediate tables in the folder that every executor shares.

``spark.checkpoint.dir`` names that folder on a cluster; only where it is unset
(tests, a laptop) is a temporary one made. A table written there cuts the
lineage and outlives the executor that wrote it.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from spanveil.shipping import ship

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in the session or set on its context; an own one where none is and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spanveil-"))
    return _own[0]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send the package to the executors, and let Arrow batches hold ``rows`` rows where the session has Spark's default of 10,000, as texts can be long. Spark itself ends a batch at 64 MB."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator call, removed when the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spanveil-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        self._held: list[DataFrame] = []  # ids stay unique
        atexit.register(self._clean)

    def _clean(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have gone before the process
            pass

    def save(self, df: DataFrame, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
        """Write ``df`` and return a scan of what was written; of about ``rows`` rows, if given, in few files of ``per_file`` or more."""
        if rows is not None:
            df = df.coalesce(max(4, -(-rows // per_file)))
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._held.append(out)
        return out

    def union(self, *tables: DataFrame) -> DataFrame:
        """One scan over saved tables of equal schema."""
        if len(tables) == 1:
            return tables[0]
        paths = [p for t in tables for p in self._paths[id(t)].split("\n")]
        out = self.spark.read.schema(tables[0].schema).parquet(*paths)
        self._paths[id(out)] = "\n".join(paths)
        self._held.append(out)
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later plan reads."""
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)

    def free(self) -> None:
        """Let Spark remove the shuffle files of finished steps; it does so once the JVM has dropped their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
