"""Session helpers: building a local session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def local_session(app: str = "countgrid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only in a local session that names none (tests on one machine) a temporary
    folder is made and removed at exit; on a cluster that would be each executor's own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="countgrid-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return "file://" + _LOCAL_DIR


_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    """Results may read scratch tables lazily, so these stay until the driver program ends."""
    for spark, root in _ROOTS:
        try:
            _delete(spark, root)
        except Exception:  # the session may have ended before
            return


class Scratch:
    """Tables written to the shared folder within one operator call.

    ``keep`` writes a DataFrame as Parquet and reads it back: the lineage ends
    there, the copy survives the loss of executors, and the file statistics let
    the planner choose joins by size. ``drop`` deletes a table that no result
    reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/countgrid-{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append((spark, self.root))

    def keep(self, df: DataFrame, *folders: str) -> DataFrame:
        """With columns named in ``folders``, which come last, their values get a folder each."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._countgrid_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_countgrid_path", None)
        if path is not None:
            _delete(self.spark, path)
            df._countgrid_path = None


    def clear(self) -> None:
        """Deletes all tables, once no result reads them any more."""
        _delete(self.spark, self.root)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys over as many tasks as the session's shuffles have.

    Adaptive execution merges small partitions by their bytes, which leaves few tasks to
    stages whose cost is computing; a number given by hand is kept.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
