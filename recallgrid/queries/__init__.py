"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F


def round_both(queries: dict, sqls: dict[str, str], columns: dict[str, list[str]], digits: int = 6) -> None:
    """Rounds doubles on both sides: the engines add in different orders, so last digits differ."""
    for name, names in columns.items():
        run = queries[name]
        queries[name] = lambda spark, d, run=run, names=names: run(spark, d).withColumns({c: F.round(c, digits) for c in names})
        sqls[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names)}) FROM ({sqls[name]})"
