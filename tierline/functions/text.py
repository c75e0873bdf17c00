"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def years_months(months: Column) -> Column:
    """27 -> '2y 3m'."""
    whole = F.floor(months / F.lit(12)).cast("int")
    return F.concat(
        whole.cast("string"), F.lit("y "), (months - whole * 12).cast("int").cast("string"), F.lit("m")
    )


def labelled(code: Column, name: Column, sep: str = "-") -> Column:
    """Code and name joined; a missing part is left out."""
    return F.concat_ws(sep, code.cast("string"), name)


def drop_first(text: Column) -> Column:
    return F.substring(text, 2, 1 << 20)
