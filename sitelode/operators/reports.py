"""Report sinks: findings and tables as JSON lines, Markdown and HTML."""

from __future__ import annotations

import html as _html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a row, in folders by the given columns."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def markdown_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each row as one Markdown table line, so a table of any size is written by the executors."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), r"\|", r"\\|")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in cols)), F.lit(" |")).alias("value"))


def markdown_table(df: DataFrame, cols: list[str], most: int = 200) -> str:
    """A small report table as Markdown, for top-k results; a longer one says that it goes on (:func:`markdown_rows` writes all)."""
    lines = [r["value"] for r in markdown_rows(df.limit(most + 1), cols).collect()]
    more = [f"\nMore than {most} rows; the first are shown."] if len(lines) > most else []
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *lines[:most], *more])


def html_table(df: DataFrame, cols: list[str], most: int = 200) -> str:
    """A small report table as HTML; for top-k results."""
    cells = lambda xs, tag: "<tr>" + "".join(f"<{tag}>{_html.escape('' if x is None else str(x))}</{tag}>" for x in xs) + "</tr>"
    rows = df.select(*cols).limit(most + 1).collect()
    more = f"<p>More than {most} rows; the first are shown.</p>" if len(rows) > most else ""
    return "<table>" + cells(cols, "th") + "".join(cells([r[c] for c in cols], "td") for r in rows[:most]) + "</table>" + more
