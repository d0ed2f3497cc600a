"""Session construction and the shared scratch area that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "assaylake", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Scratch:
    """Tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    A written table survives the loss of executors, is compressed and can be pruned, which the
    binary files of ``checkpoint()`` can't. Only where the setting is absent and the master is local (tests) a local folder
    is made; on a cluster a folder of one machine would lose tables with it, so that is an error. ``drop`` removes a table as soon as nothing reads it any more; what a lazily returned
    result still needs is removed when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="assaylake-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/assaylake-{uuid.uuid4().hex[:12]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.base))

    def path(self, name: str) -> str:
        """Where a table or file of this name is; it is removed like the tables."""
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Materialise ``df`` as a table and return a scan of it."""
        path = f"{self.base}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.base}/{name}"), True)
