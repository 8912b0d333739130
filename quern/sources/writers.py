"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import canonical_json


def write_json_lines(df: DataFrame, path: str, order: Sequence[Column] = (), *, one_file: bool = False) -> None:
    """Canonical JSON lines; in one file, in order, only where byte order matters (small artifacts), else a part per task, range-partitioned by the order."""
    lines = df.select(canonical_json(df).alias("value"), *(c.alias(f"__k{i}") for i, c in enumerate(order)))
    keys = [F.col(f"__k{i}") for i in range(len(order))]
    if order:
        lines = lines.orderBy(*keys)
    lines = lines.select("value")
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One canonical JSON object."""
    write_json_lines(df.limit(1), path, one_file=True)


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report as Markdown: title, header, a line per row. For reports only: more than ``most`` rows raise ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    said = lambda v: "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(said, r))} |" for r in rows]) + "\n"


def set_aside(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Renames an output before a fresh run; returns where it is now, None if there was none. A name that is taken raises FileExistsError."""
    p, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path.rstrip('/')}.{stamp}"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    if fs.exists(to):
        raise FileExistsError(to.toString())
    fs.rename(p, to)
    return to.toString()


def rewrite(df: DataFrame, path: str, stamp: str) -> None:
    """Overwrites an append-only history: written beside it, then put in its place, the old one kept under the stamp."""
    df.write.json(f"{path.rstrip('/')}.new")
    set_aside(df.sparkSession, path, stamp)
    fresh, to = (df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path.rstrip('/')}.new", path))
    fresh.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).rename(fresh, to)
