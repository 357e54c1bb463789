"""Session helpers: a default local session and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "codexmill", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches, as named in spark.checkpoint.dir.

    Only where that setting is absent (local runs and tests) a folder of our own is set, since on a cluster a
    machine-local folder would be lost with its executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="codexmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written intermediate table, in a folder of this application under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/codexmill/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def erase(spark: SparkSession, where: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed any more."""
    erase(spark, f"{shared_dir(spark).rstrip('/')}/codexmill/{spark.sparkContext.applicationId}")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run within go as they end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df, what: str, path: str | None = None):
    """df written to the shared folder (at path, if given) and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session: their Python may have been started without its path."""
    context = spark.sparkContext
    if getattr(context, "_codexmill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="codexmill-"), "codexmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("codexmill", os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._codexmill_shipped = True


def default_data_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
