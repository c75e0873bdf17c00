"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.sources.views import VIEW_SQL, Tables, duckdb_text

SNAP = "2001-06-30"
DIGITAL_SNAP = "2024-01-31"

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_DERIVED: dict[str, str] = {}


def derived(name: str, sql: str) -> None:
    """A named intermediate result the check SQL of several queries builds on."""
    _DERIVED[name] = sql.strip()


def query(name: str, sql: str | None = None, text: Sequence[str] = ()):
    """Register a query; `text` lists date columns that both sides return as text."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(t: Tables) -> DataFrame:
            df = fn(t)
            return df.withColumns({c: F.col(c).cast("string") for c in text}) if text else df

        _QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if text:
                casts = ", ".join(f"cast({c} as varchar) as {c}" for c in text)
                body = f"select * replace ({casts}) from ({body}) outermost"
            _SQL[name] = body
        return fn

    return register


def _needs(sql: str) -> list[str]:
    return re.findall(r"\b(?:from|join)\s+(\w+)", sql, flags=re.IGNORECASE)


def _collect(sql: str, found: dict[str, str]) -> None:
    for name in _needs(sql):
        if name in found:
            continue
        text = _DERIVED.get(name) or (duckdb_text(name).strip() if name in VIEW_SQL else None)
        if text is not None:
            _collect(text, found)
            found[name] = text


def full_sql(name: str) -> str:
    """The check SQL with the views and intermediate results it uses in front."""
    found: dict[str, str] = {}
    _collect(_SQL[name], found)
    if not found:
        return _SQL[name]
    ctes = ",\n".join(f"{n} as ({text})" for n, text in found.items())
    return f"with {ctes}\nselect * from (\n{_SQL[name]}\n) result"


def _load() -> None:
    from tierline.catalog import activation_checks, cluster_checks, customer_checks, income_checks, operator_checks, sales_checks

    _ = (activation_checks, cluster_checks, customer_checks, income_checks, operator_checks, sales_checks)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {
        name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for name, fn in _QUERIES.items()
    }


def all_sql() -> dict[str, str]:
    _load()
    return {name: full_sql(name) for name in _SQL}


# Pieces of check SQL.


def money(expr: str, scale: int = 2) -> str:
    """Sum in fixed point. Beyond cents the value goes through text, so that halves round up as in
    Spark whatever the binary digits."""
    value = f"cast({expr} as varchar)" if scale > 2 else expr
    return f"cast(sum(cast({value} as decimal(18,{scale}))) as double)"


def money0(expr: str, scale: int = 2) -> str:
    return f"coalesce({money(expr, scale)}, 0.0e0)"


def average(expr: str, scale: int = 2) -> str:
    return f"{money(expr, scale)} / nullif(count({expr}), 0)"


def months_between(a: str, b: str) -> str:
    return (
        f"round((year({a}) - year({b})) * 12 + month({a}) - month({b})"
        f" + case when day({a}) = day({b}) or ({a} = last_day({a}) and {b} = last_day({b})) then 0"
        f" else (day({a}) - day({b})) / 31.0e0 end, 8)"
    )


def offset(d: str) -> str:
    year, month = int(SNAP[:4]), int(SNAP[5:7])
    return f"(year({d}) * 12 + month({d}) - {year * 12 + month} - 1)"


def windows(d: str) -> dict[str, str]:
    o, year = offset(d), int(SNAP[:4])
    return {
        "last_yr": f"year({d}) = {year - 1}",
        "last_mth": f"{o} = -1",
        "last_3m": f"{o} between -3 and -1",
        "last_6m": f"{o} between -6 and -1",
        "last_9m": f"{o} between -9 and -1",
        "last_12m": f"{o} between -12 and -1",
        "ytd": f"year({d}) = {year} and {o} <= -1",
        "total": f"{o} <= -1",
    }
