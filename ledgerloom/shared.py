"""The folder that driver and executors share, tables staged in it, and versioned tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is absent, a temporary folder for sessions without a cluster only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return _OWN[0]


def _fs(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of a large shuffle gets, about.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to a task for every TASK_ROWS of rows; as it is where Spark's own number of partitions is as many."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def scratch(spark: SparkSession, tag: str, held: int = 2) -> Callable[..., DataFrame]:
    """A stage() for rounds that build on one another: of tables that aren't kept only the last held stay on disk."""
    folder, old = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", []

    def cut(df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if not keep:
            old.append(path)
        while len(old) > held:
            delete(spark, old.pop(0))
        return spark.read.schema(df.schema).parquet(path)

    return cut


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; fails if there is one."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode()
    finally:
        source.close()


#: Buckets that the rows of a keyed table are dealt to.
BUCKETS = 64
BUCKET = "_bucket"


class Table:
    """A table of versions under a folder: a write makes a new one, which readers see once it is whole.

    A version is all rows of the table, or a list of buckets, each with the version whose write it
    is from: a merge by key reads and writes the buckets of its keys only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def versions(self) -> list[int]:
        found = [int(v[2:]) for v in children(self.spark, self.path) if v.startswith("v=")]
        return sorted(v for v in found if exists(self.spark, f"{self.path}/v={v}/_SUCCESS"))

    def _next(self) -> int:
        return 1 + max((int(v[2:]) for v in children(self.spark, self.path) if v[:2] in ("v=", "d=")), default=0)

    def _list(self, version: int | None) -> dict | None:
        """Schema and buckets of a version that is a list."""
        path = f"{self.path}/v={version}/_buckets"
        return json.loads(get_text(self.spark, path)) if version and exists(self.spark, path) else None

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of a version, by default of the newest whole one, or of some of its buckets; None if there is none."""
        version = version or max(self.versions(), default=None)
        if version is None:
            return None
        held = self._list(version)
        if held is None:
            return self.spark.read.parquet(f"{self.path}/v={version}")
        schema, some = StructType.fromJson(held["schema"]), None if buckets is None else set(buckets)
        paths = [f"{self.path}/d={v}/{BUCKET}={b}" for b, v in held["held"].items() if some is None or int(b) in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, *partitions: str, held: int | None = 2) -> DataFrame:
        """Put df as the newest version and delete those older than the last held ones."""
        version = self._next()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.path}/v={version}")
        self._forget(held)
        return self.read(version)

    def bucket(self, *keys: Column | str) -> Column:
        """The bucket of a row's keys: of as many as the table has been dealt to, whatever the number that it was opened with."""
        held = self._list(max(self.versions(), default=None))
        return F.pmod(F.xxhash64(*keys), F.lit(held["buckets"] if held else self.buckets)).cast("int")

    def merge(self, rows: DataFrame, keys: list[str], combine: Callable[[DataFrame], DataFrame], held: int | None = 2) -> DataFrame:
        """Put rows into the buckets of their keys: combine gets those buckets' rows, old and new, and returns what they hold then.

        combine must give the same rows if some of the new ones are old already; then a merge that
        is run again changes nothing. Buckets without new rows are neither read nor written, and
        where two merge at once the second fails. A table written whole is dealt to buckets first.
        """
        bucket = self.bucket(*keys)
        rows = stage(rows.withColumn(BUCKET, bucket), "writes")
        last, version = max(self.versions(), default=None), self._next()
        old = self._list(last)
        touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        if last is not None and old is None:
            before, kept = self.read(last), {}
        else:
            before, kept = (self.read(last, touched), old["held"]) if old else (None, {})
        both = rows.drop(BUCKET) if before is None else before.unionByName(rows.drop(BUCKET), allowMissingColumns=True)
        merged = combine(both)
        # a bucket's rows go to as many files as they need
        merged.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/d={version}")
        new = {c.rpartition("=")[2]: version for c in children(self.spark, f"{self.path}/d={version}") if c.startswith(BUCKET)}
        kept = {b: v for b, v in kept.items() if int(b) not in touched} | new
        put_text(self.spark, f"{self.path}/v={version}/_buckets", json.dumps({"buckets": old["buckets"] if old else self.buckets, "schema": merged.schema.jsonValue(), "held": kept}))
        put_text(self.spark, f"{self.path}/v={version}/_SUCCESS", "")
        self._forget(held)
        return self.read(version)

    def _forget(self, held: int | None) -> None:
        if held:
            found = self.versions()
            self.keep(v for v in found if v > found[-1] - held)

    def keep(self, wanted: Iterable[int]) -> None:
        """Delete all versions before the newest one that aren't wanted, and the buckets that none left has."""
        newest = max(self.versions(), default=0)
        wanted = {*wanted, newest}
        for v in children(self.spark, self.path):
            if v.startswith("v=") and int(v[2:]) < newest and int(v[2:]) not in wanted:
                delete(self.spark, f"{self.path}/{v}")
        used = {(int(v), b) for w in wanted if (x := self._list(w)) for b, v in x["held"].items()}
        for d in children(self.spark, self.path):
            if d.startswith("d=") and int(d[2:]) <= newest:
                own = [c for c in children(self.spark, f"{self.path}/{d}") if c.startswith(BUCKET)]
                left = [c for c in own if (int(d[2:]), c.rpartition("=")[2]) in used]
                for c in own if left else ():
                    if c not in left:
                        delete(self.spark, f"{self.path}/{d}/{c}")
                if not left:
                    delete(self.spark, f"{self.path}/{d}")

    def clear(self) -> None:
        delete(self.spark, self.path)
