"""Session factory and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 64 << 20


def get_session(app: str = "chronoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, as in tests, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "chronoloom-shared")
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_chronoloom_sent", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="chronoloom-")) / "chronoloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("chronoloom") / p.relative_to(root))
    sc.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)  # the driver serves it until then
    sc._chronoloom_sent = True
    # batches of long texts are bounded by their bytes, where this Spark can do that
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None or int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Remove the tables that cut() has written so far: for long sessions, once the results that read them have been saved."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(release)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which release() removes."""
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def cut(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The table outlives lost executors. It is removed by release(), or when the driver's Python ends. The job runs here and now: plans that read a
    step several times would otherwise compute it as often.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
