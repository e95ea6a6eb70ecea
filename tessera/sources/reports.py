"""Sinks for results: JSON files, Markdown tables and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..storage import write_file


def number(value: object, digits: int = 2) -> str:
    """A cell: numbers with thousands separated, floats rounded, null a dash."""
    if value is None:
        return "—"
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{value:,.{digits}f}" if isinstance(value, float) else f"{value:,}"


def percent(share: float | None) -> str:
    return "—" if share is None else f"{share * 100:.2f}%"


def markdown_table(rows: list[dict], shares: tuple[str, ...] = ()) -> str:
    """Rows of one shape as a table; ``shares``: columns shown as percentages."""
    if not rows:
        return "(none)\n"
    names = list(rows[0])
    cell = lambda n, v: (percent(v) if n in shares else number(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(n, r[n]) for n in names) + " |" for r in rows]) + "\n"


def report(title: str, parts: dict[str, DataFrame | list[dict]], most: int = 200) -> tuple[str, dict]:
    """(Markdown, JSON-ready) of small tables by heading. A table of more than ``most`` rows is refused: reports are read."""
    text, out = [f"# {title}\n"], {}
    for heading, part in parts.items():
        rows = part if isinstance(part, list) else [r.asDict(recursive=True) for r in part.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{heading} has more than {most} rows")
        shares = tuple(n for n in (rows[0] if rows else {}) if n.endswith(("rate", "share")))
        text.append(f"## {heading}\n\n{markdown_table(rows, shares)}")
        out[heading] = rows
    return "\n".join(text), out


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_file(spark, path, json.dumps(value, indent=2, default=str) + "\n")


def write_markdown(spark: SparkSession, path: str, text: str) -> None:
    write_file(spark, path, text)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, in parallel."""
    df.write.mode("error").option("ignoreNullFields", "false").json(path)
