"""Session builder for local runs and the shared scratch folder of a job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Landed steps by application, for :func:`discard_steps`.
_STEPS: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", app: str = "stocklens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    There is no fallback: a folder of one machine would lose steps on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application.

    Spark distributes the archive, so tasks can import the package wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_stocklens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="stocklens-package-"), "stocklens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._stocklens_shipped = True


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder; nothing is created or cleared."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex}")


def landed(df: DataFrame, purpose: str = "step", lasting: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage for good: later stages read columns of files, an executor lost meanwhile costs
    nothing that was written, and the planner knows the size.  The step stays until
    :func:`discard_steps`, a ``lasting`` one beyond.
    """
    path = run_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    if not lasting:
        _STEPS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modified(spark: SparkSession, path: str) -> int:
    """When ``path`` last changed, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(place).getModificationTime()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard_steps(spark: SparkSession) -> None:
    """Delete what this application has landed below the shared folder.

    Tables of an outcome are read from landed steps, so call this once they are written elsewhere.
    """
    taken = _STEPS.pop(spark.sparkContext.applicationId, [])
    for path in taken:
        remove(spark, path)
