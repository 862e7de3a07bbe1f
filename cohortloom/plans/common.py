"""Small helpers shared by the operator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six digits, so that two engines agree on the last bits."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def issues_sql(rows: str) -> str:
    """SELECT of check rows from ``(check_name, code, n, examples)`` selects."""
    return f"select check_name, 'ERROR' as level, code, cast(n as bigint) as n, examples from ({rows})"


def top5_sql(source: str, column: str, check: str, code: str) -> str:
    """One check row: offenders and their first five distinct examples."""
    return (
        f"select '{check}' as check_name, '{code}' as code, (select count(*) from {source}) as n, "
        f"coalesce((select string_agg(x, ', ' order by x) from (select distinct cast({column} as varchar) as x from {source} "
        f"where {column} is not null order by x limit 5)), '') as examples"
    )
