"""Sinks: CSV, JSON, list columns, Markdown reports, versions and write-once tables."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, write: bool = True) -> DataFrame:
    """``write=False`` plans without writing."""
    if write:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df


def write_json(df: DataFrame, path: str, write: bool = True) -> DataFrame:
    if write:
        df.write.mode("overwrite").json(path)
    return df


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """A new folder beside the old ones: what is being read is never overwritten."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def join_lists(df: DataFrame, columns, separator: str = "|") -> DataFrame:
    return df.withColumns({c: F.array_join(c, separator) for c in columns})


def split_lists(df: DataFrame, columns, separator: str = "|") -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, f"\\Q{separator}\\E")) for c in columns})


def markdown_table(df: DataFrame, rows: int = 50, width: int = 500) -> str:
    """A pipe table of the first rows, for reports."""
    def cell(v):
        return ("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")[:width]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect()])


def report(title: str, sections) -> str:
    """A Markdown document of (heading, text or DataFrame) sections."""
    parts = [f"# {title}"]
    for heading, body in sections:
        parts += [f"## {heading}", markdown_table(body) if isinstance(body, DataFrame) else str(body)]
    return "\n\n".join(parts) + "\n"
