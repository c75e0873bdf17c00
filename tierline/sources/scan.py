"""Reading tables: columnar, snapshot, delimited, catalog, several locations, fallback snapshot."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.sources.sink import stage


def scan_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_snapshot(spark: SparkSession, path: str, part_col: str, snapshot) -> DataFrame:
    """One snapshot of a table laid out by `part_col`; the filter prunes directories."""
    return spark.read.parquet(path).filter(F.col(part_col) == F.lit(snapshot))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Delimited text with a header line. The schema is given, so the text is read once only."""
    return spark.read.csv(path, schema=schema, header=True)


_LINE = "_line"


def scan_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Delimited text with a header line, as (typed rows, lines that do not fit the schema).

    A line with a value of another type, or with too few or too many values, becomes no row with silent nulls: it
    goes, whole, to the second frame (`file`, `line`). The text is read once; both frames come from one written
    table, so that they agree whatever is asked of them. Empty values are nulls in both readings.
    """
    wanted = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    text = spark.read.csv(path, schema=wanted, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE)
    both = stage(text.withColumn("_file", F.input_file_name()), "csv-lines")
    rows = both.filter(F.col(_LINE).isNull()).select(*schema.names)
    return rows, both.filter(F.col(_LINE).isNotNull()).select(F.col("_file").alias("file"), F.col(_LINE).alias("line"))


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def load_tables(
    spark: SparkSession,
    paths: Iterable[str],
    names: Iterable[str],
    register: bool = True,
    suffix: str = "",
) -> dict[str, DataFrame]:
    """Look each name up under each path in turn; the first path that has it wins.

    Keys are upper case; `suffix` is added to the name in the path. With `register` each frame also becomes a temp view of its lower-case name.
    """
    found: dict[str, DataFrame] = {}
    for name in names:
        for path in paths:
            try:
                df = spark.read.parquet(f"{path}/{name}{suffix}")
            except AnalysisException as err:
                if "PATH_NOT_FOUND" not in str(err):
                    raise
                continue
            found[name.upper()] = df
            if register:
                df.createOrReplaceTempView(name.lower())
            break
        else:
            raise FileNotFoundError(f"table {name} is under none of the given paths")
    return found


def snapshot_or_latest(df: DataFrame, col: str, wanted: Column) -> DataFrame:
    """Rows of the newest snapshot not after `wanted`; else of the newest; none if the table is empty.

    The choice is one scalar subquery, so on a partition column it still prunes directories.
    """
    seen = F.col(col)
    choice = df.agg(
        F.coalesce(F.max(F.when(seen <= wanted, seen)), F.max(seen)).alias("chosen")
    ).scalar()
    return df.filter(seen == choice)


_READ_AS = {int: int, str: str, dt.date: dt.date.fromisoformat}


def snapshots_of(spark: SparkSession, path: str, part_col: str) -> dict[str, str]:
    """Values of the partition column and their directories, by the names of these. No file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(root, f"{part_col}=*")
    )
    folders = [s.getPath().getName() for s in listed or [] if s.isDirectory()]
    found = {unquote(f.split("=", 1)[1]): f for f in folders}
    found.pop("__HIVE_DEFAULT_PARTITION__", None)
    return found


def scan_snapshot_or_latest(spark: SparkSession, path: str, part_col: str, wanted: int | str | dt.date) -> DataFrame:
    """`snapshot_or_latest` over a table laid out by `part_col`: the newest snapshot not after `wanted`, else the newest.

    The choice is made by the names of the directories, one driver call to the file system; only the files of the
    chosen snapshot are listed and read. Rows without a snapshot are never chosen. A table without a snapshot
    raises FileNotFoundError.
    """
    parse = _READ_AS[type(wanted)]
    known = {parse(name): folder for name, folder in snapshots_of(spark, path, part_col).items()}
    if not known:
        raise FileNotFoundError(f"no {part_col}=... under {path}")
    chosen = max((k for k in known if k <= wanted), default=max(known))
    found = spark.read.option("basePath", path).parquet(f"{path}/{known[chosen]}")
    return found.filter(F.col(part_col) == F.lit(chosen))


def unwrap_record(df: DataFrame, field: str) -> DataFrame:
    """Promote the fields of a struct column to top-level columns; void fields become strings."""
    inner = df.schema[field].dataType
    return df.select(
        *[
            F.col(f"{field}.{f.name}").cast("string").alias(f.name)
            if isinstance(f.dataType, T.NullType)
            else F.col(f"{field}.{f.name}")
            for f in inner.fields
        ]
    )
