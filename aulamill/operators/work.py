"""Shared working storage and joins on keys that may be hot.

Intermediate results that more than one later job reads are written as Parquet
tables into the shared folder that ``spark.checkpoint.dir`` names, so a lost
executor costs a re-read and never a recomputation of the whole lineage. Only
on a local master without that setting (tests, a laptop) a local folder is used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it has at least 1/HOT_SHARE of all rows, so there are at
#: most HOT_SHARE hot keys whatever the data: the bound of every broadcast here.
HOT_SHARE = 1000

_local: dict[str, str] = {}
_folders: dict[str, str] = {}
_shipped: set[str] = set()


def work_root(spark: SparkSession) -> str:
    """The shared folder for working tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local.setdefault(app, tempfile.mkdtemp(prefix="aulamill-"))
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="aulamill-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a working table, in a folder of the application that is deleted when it ends."""
    app = spark.sparkContext.applicationId
    folder = f"{work_root(spark)}/aulamill-{app}"
    if _folders.get(app) != folder:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
        _folders[app] = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, keeps column pruning."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Passing:
    """Working tables that are deleted, with the shuffle files of the jobs that are over, when what reads them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())
        free_shuffles(self.spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over, which else stay until the driver happens to collect its garbage.

    The scheduler holds the last job until the next one runs, and events hold its plan until all listeners had them.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a working table that no pending result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def digest(*cols) -> F.Column:
    """256-bit content hash of the columns, unambiguous about where one ends (null differs from '')."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique ``key``) that survives hot keys.

    ``weight`` is the number of rows each key has in ``rows`` and ``total`` their
    sum. Keys with total/HOT_SHARE rows or more - at most HOT_SHARE of them by
    arithmetic - are broadcast, so their rows never meet in one task; all others
    take a shuffled join.
    """
    hot_filter = F.col(weight) * HOT_SHARE >= F.lit(max(total, HOT_SHARE * 1000))
    plain = keyed.where(~hot_filter).drop(weight)
    hot = keyed.where(hot_filter).drop(weight)
    if not hot.head(1):
        return rows.join(plain, key)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(plain, key)
    )


def ranked(rows: DataFrame, group: list[str], order: str, name: str = "nth") -> DataFrame:
    """Adds the place (from 0) of each row in its group, by the unique ``order``; a group of any size is spread over tasks.

    Rows are range-sorted once; of each group one row per partition meets in a window.
    """
    ordered = stored(
        rows.repartitionByRange(*group, order)
        .sortWithinPartitions(*group, order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    spans = ordered.groupBy("part", *group).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_here"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n_here").over(earlier), F.lit(0)))
    spans = spans.drop("n_here")
    # Without a group this is one row per partition.
    joined = ordered.join(spans if group else F.broadcast(spans), ["part", *group])
    return joined.withColumn(name, F.col("before") + F.col("seq") - F.col("first_seq")).drop("part", "seq", "first_seq", "before")
