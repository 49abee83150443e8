"""Markdown reports of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of a report is for reading; a larger one is refused, not cut.
MOST = 1000


def table(df: DataFrame, most: int = MOST) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def markdown(title: str, sections: dict[str, DataFrame], most: int = MOST) -> str:
    return "\n".join([f"# {title}\n", *(f"## {name}\n\n{table(df, most)}" for name, df in sections.items())])
