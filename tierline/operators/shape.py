"""Column-level reshaping of a frame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_columns(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def strip_names(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.toDF(*[c.removeprefix(prefix).removesuffix(suffix) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def cast_family(df: DataFrame, from_type: type | tuple[type, ...], to_type: str) -> DataFrame:
    """Cast every column of one family of types, e.g. all decimals to double."""
    return df.select(
        *[
            F.col(f.name).cast(to_type).alias(f.name)
            if isinstance(f.dataType, from_type)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def fill_nulls(df: DataFrame, spec: object, subset: Iterable[str] | None = None) -> DataFrame:
    """A number fills numeric columns, a text fills text columns, a dict fills by column."""
    if isinstance(spec, Mapping):
        return df.na.fill(dict(spec))
    return df.na.fill(spec, list(subset) if subset else None)


def project(df: DataFrame, cols: Iterable[str], drop: bool = False) -> DataFrame:
    return df.drop(*cols) if drop else df.select(*cols)
