"""Session settings, staged tables and the shared folder they live in."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []
_memo: dict[tuple, tuple] = {}
_held: list[DataFrame] = []
_shipped: set[str] = set()


def local_session(cpus: int = 8, app: str = "arcseq") -> SparkSession:
    """Session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "arcseq.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a scratch folder only where that setting is absent on a single machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master or 'this cluster'} share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _local_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/arcseq/{label}-{uuid.uuid4().hex}"


def _is_complete(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write(df: DataFrame, label: str, *partitions: str) -> tuple[DataFrame, str]:
    """Write `df` once and read it back: cuts the lineage and survives the loss of executors. With the folder it lies in."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """A written table that is kept as long as the shared folder."""
    return write(df, label, *partitions)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table made by `write` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged_once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Staged table shared by all queries of one session."""
    full = (spark.sparkContext.applicationId, *key)
    path, schema = _memo.get(full, (None, None))
    if path is None or not _is_complete(spark, path):
        df = build()
        path, schema = new_path(spark, "-".join(str(k).strip("/").replace("/", "_") for k in key)), df.schema
        df.write.mode("overwrite").parquet(path)
        _memo[full] = (path, schema)
    return spark.read.schema(schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Persist a table that is read several times by one computation."""
    df = df.persist()
    _held.append(df)
    return df


def release() -> None:
    """Drop everything persisted by `hold`."""
    while _held:
        _held.pop().unpersist()
