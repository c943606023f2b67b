"""Where results go: JSON lines, CSV with a fixed header, and small reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """A line for each row, with its keys in order and nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns under their header; what a row lacks is empty."""
    have = set(df.columns)
    df.select(*(F.col(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def table_cell(value: object) -> str:
    return str("" if value is None else value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report's table as Markdown: at most limit rows of a result that is already a summary; a last line says so where there are more."""
    rows = df.limit(limit + 1).collect()
    lines = [df.columns, ["---"] * len(df.columns), *rows[:limit]]
    table = "\n".join("| " + " | ".join(map(table_cell, line)) + " |" for line in lines)
    return table + (f"\n\nOnly {limit} rows are shown; there are more." if len(rows) > limit else "")


def pretty_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
