"""Writing tables, and cutting a long lineage by writing to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`.

    Where it is unset a session that runs in this process alone gets a temporary folder of its own;
    any other is refused, because executors cannot see a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="tierline-")
        _LOCAL_DIRS[app] = named
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile takes its shuffle files with it. Otherwise Spark keeps them until the driver happens to collect
    the garbage they belong to."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Overwrite `path` and read it back: a columnar cut in the lineage that outlives executors. The shuffle files of the
    write are not kept."""
    with _shuffles_end(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """`materialise` under a new name in the shared folder."""
    return materialise(df, fresh_path(df.sparkSession, label))


def forget(df: DataFrame, labels: Iterable[str]) -> None:
    """Remove the stages of these labels that `df` reads: once what `df` gives is written, where nothing else reads them."""
    spark, wanted = df.sparkSession, set(labels)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in sorted({name.rpartition("/")[0] for name in df.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))  # names of read files are encoded
        found = re.fullmatch(r"(.+)-[0-9a-f]{32}", path.getName())
        if found and found[1] in wanted:
            path.getFileSystem(conf).delete(path, True)


def stage_last(df: DataFrame, label: str, spent: Iterable[str]) -> DataFrame:
    """`stage` of the last frame that reads the stages `spent`."""
    out = stage(df, label)
    forget(df, spent)
    return out


def write_partitions(df: DataFrame, path: str, part_cols: Iterable[str]) -> None:
    """Replace only the partitions that occur in `df`. Rows of one partition are brought together
    first, several tasks per hot partition, so that the file count stays small."""
    cols = list(part_cols)
    (
        df.hint("rebalance", *cols)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols)
        .parquet(path)
    )


_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def save_table(df: DataFrame, name: str, part_cols: Iterable[str], path: str | None = None) -> None:
    """Write to a partitioned table of the catalog. The first write creates it; a later one replaces
    the partitions that occur in `df` and keeps the others. Columns go by name."""
    spark, cols = df.sparkSession, list(part_cols)
    spread = df.hint("rebalance", *cols)
    if not spark.catalog.tableExists(name):
        writer = spread.write.partitionBy(*cols)
        (writer.option("path", path) if path else writer).saveAsTable(name)
        return
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        spread.select(spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
