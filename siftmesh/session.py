"""Session helpers: settings, the shared folder and intermediate tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_run = uuid.uuid4().hex[:12]
_base: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftmesh")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and the master is a plain
    ``local`` one, as in tests; a cluster without the setting is an error.
    """
    base = _configured_dir(spark)
    if base is None:
        app = spark.sparkContext.applicationId
        if app not in _base:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _base[app] = "file://" + tempfile.mkdtemp(prefix="siftmesh-shared-")
        base = _base[app]
    return f"{base.rstrip('/')}/siftmesh-{_run}"


def local_shared_path(spark: SparkSession) -> str | None:
    """The shared folder as a plain path, or None if it lies in a file system that needs a client."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        return "/" + base[5:].lstrip("/")
    return base if base.startswith("/") else None


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one query in the shared folder.

    ``write`` cuts the lineage: what follows reads files that outlive any executor. ``drop`` deletes a
    table once nothing reads it any more; what a returned DataFrame still reads stays until the
    interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.count = 0
        atexit.register(self._clean)

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{tag}"

    def write(self, df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(tag)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siftmesh_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if path := getattr(table, "_siftmesh_path", None):
                delete(self.spark, path)

    def _clean(self) -> None:
        try:
            delete(self.spark, self.base)
        except Exception:  # the session has gone, and its folder with it
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a session.

    The package goes as an archive in the shared folder, which Spark itself hands to the executors. Where that
    folder needs a client, the package is taken to be installed or given by ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    base = local_shared_path(spark)
    if app in _shipped or base is None:
        return
    package = Path(__file__).resolve().parent
    Path(base).mkdir(parents=True, exist_ok=True)
    archive = f"{base}/siftmesh-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
