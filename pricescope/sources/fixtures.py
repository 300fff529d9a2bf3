"""The SQL of small tables of expected rows."""

from __future__ import annotations


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float) and value != value:
        return "CAST('NaN' AS DOUBLE)"
    if isinstance(value, list):
        return f"CAST([{', '.join(map(_literal, value))}] AS VARCHAR[])"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with the rows, each column cast to its type."""
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "int": "INTEGER", "array<string>": "VARCHAR[]"}
    split = [c.split(" ") for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in split)
    names = ", ".join(n for n, _ in split)
    return f"{name} AS (SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({names}))"
