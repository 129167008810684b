"""Files that tasks write to and read from the shared folder, by URI."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from arcseq.session import new_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder below spark.checkpoint.dir, resolved as Spark's writers would."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, label))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts: list[bytes]) -> None:
    """Write a file under its final name only once it is whole; a task that runs again replaces it by the same bytes."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def get(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
