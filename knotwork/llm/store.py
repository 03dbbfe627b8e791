"""Tables that cut lineage, in the folder that the whole cluster shares.

`spark.checkpoint.dir` names that folder. Where it is unset (tests on one machine) a temporary
folder is made, and only for a local master: executors elsewhere could not see it.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scoped: dict[str, list[str]] = {}
#: Names in the catalog, by path; folders that go when Python ends, by session.
_tables: dict[str, str] = {}
_swept: dict[int, str] = {}

#: Rows and bytes that one Arrow batch may carry to Python, so that long texts stay bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh(spark: SparkSession, name: str, scope: str = "") -> str:
    """A new path below the shared folder. Paths of a scope go with `clear`."""
    home = f"{root(spark)}/knotwork/{spark.sparkContext.applicationId}"
    if id(spark) not in _swept:
        _swept[id(spark)] = home
        atexit.register(_sweep, spark)
    path = f"{home}/{name}-{uuid.uuid4().hex[:12]}"
    if scope:
        _scoped.setdefault(scope, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession, scope: str) -> None:
    """Delete what the scope wrote; for callers whose results are already written elsewhere."""
    for path in _scoped.pop(scope, []):
        if path in _tables:
            spark.sql(f"drop table if exists {_tables.pop(path)}")
        delete(spark, path)


def _sweep(spark: SparkSession) -> None:
    """What the session wrote goes with it, as far as it can still be reached."""
    with contextlib.suppress(Exception):
        for table in _tables.values():
            spark.sql(f"drop table if exists {table}")
    with contextlib.suppress(Exception):
        delete(spark, _swept.pop(id(spark)))


def written(df: DataFrame, name: str, scope: str = "", compression: str = "snappy") -> DataFrame:
    """The same rows, read back from a Parquet table: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name, scope)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str, scope: str = "") -> DataFrame:
    """The same rows in a table of buckets by a column: joins on it move the other side alone."""
    spark = df.sparkSession
    path = fresh(spark, name, scope)
    table = "knotwork_" + path.rpartition("-")[2]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(parts, by).write.format("parquet").option("compression", "zstd").option("path", path)
    out.bucketBy(parts, by).sortBy(by).saveAsTable(table)
    _tables[path] = table
    return spark.table(table)


def bounded_batches(spark: SparkSession) -> None:
    """Keep what goes to a Python worker at once small, however long the texts are."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        spark.conf.set(key, str(most))
