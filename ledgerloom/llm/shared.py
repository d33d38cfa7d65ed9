"""What the corpus operators share: the shared folder, staged tables and files in it."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent, a temporary folder serves local sessions only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return _OWN[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "_staged", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI or plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only once it is whole, so that a retried task is harmless.

    Object stores show a file once its stream is closed; elsewhere a temporary name is used until
    then. As a context it is closed at the end, or removed after an error.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.direct = self.fs.type_name in ("s3", "gcs", "abfs")
        self.temporary = self.path if self.direct else f"{self.path}.{uuid.uuid4().hex}.tmp"
        if not self.direct:
            self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        if not self.direct:
            self.fs.move(self.temporary, self.path)

    def abort(self) -> None:
        if not self.direct:
            self.out.close()
            self.fs.delete_file(self.temporary)

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()
