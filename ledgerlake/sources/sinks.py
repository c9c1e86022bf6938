"""Result sinks: JSON rows and envelopes, text tables, vertical rows, and a file that keeps what was shown."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a printed table or of a JSON envelope unless more are asked for: both are read by one reader on the driver.
SHOWN = 1000


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row in column value, nulls included; written by Spark like any other table."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def envelope(df: DataFrame | None, error: str | None = None, rows: int = SHOWN) -> str:
    """success, data and error of one result as a JSON text."""
    data: list[Any] | None = None if df is None else [json.loads(r.value) for r in json_rows(df).take(rows)]
    return json.dumps({"success": error is None, "data": data, "error": error}, ensure_ascii=False)


def cells(df: DataFrame, rows: int) -> list[list[str]]:
    return [["NULL" if x is None else str(x) for x in r] for r in df.take(rows)]


def table_text(df: DataFrame, rows: int = SHOWN) -> str:
    """A box of columns as wide as their widest cell, and the number of rows shown."""
    body = cells(df, rows)
    width = [max(len(x) for x in column) for column in zip(df.columns, *body, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda row: "|" + "|".join(f" {x:<{w}} " for x, w in zip(row, width, strict=True)) + "|"
    return "\n".join([rule, line(df.columns), rule, *(line(r) for r in body), *([rule] if body else []), f"{len(body)} rows"])


def vertical_text(df: DataFrame, rows: int = SHOWN) -> str:
    """Each row as lines of column and value."""
    width = max((len(c) for c in df.columns), default=0)
    parts = []
    for i, row in enumerate(cells(df, rows), 1):
        parts.append(f"-- row {i}")
        parts += [f"{c:>{width}}: {x}" for c, x in zip(df.columns, row, strict=True)]
    return "\n".join(parts)


class Tee:
    """Prints, and keeps a copy in a file until closed."""

    def __init__(self, show=print):
        self.show, self.file = show, None

    def open(self, path: str) -> None:
        self.close()
        self.file = open(path, "a", encoding="utf-8")  # noqa: SIM115

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def __call__(self, text: str) -> None:
        self.show(text)
        if self.file is not None:
            self.file.write(text + "\n")
            self.file.flush()
