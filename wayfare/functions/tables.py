"""Small tables of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(x: int | str) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(spark: SparkSession, rows: list[tuple[int | str, ...]], columns: list[str]) -> DataFrame:
    """Rows that stand in the plan itself: no job reads them."""
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
