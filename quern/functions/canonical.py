"""Canonical JSON and content digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row: keys sorted at every level, no blanks, nulls kept, text unescaped. NaN raises no error in Spark, so it is written as a string, never as bare NaN."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*(_sorted(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names)), {"ignoreNullFields": "false"})


def digest(df: DataFrame, line: Column, order: Sequence[Column], sep: str = "\n", around: tuple[str, str] = ("", "")) -> DataFrame:
    """One row (digest): SHA-256 of the lines in order, joined. Defined over the whole text, so the lines go to one task: for artifacts of a size to be hashed as one file. ``tree_digest`` is for larger tables."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    lines = df.select(F.struct(*keys, line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select(F.sha2(F.concat(F.lit(around[0]), F.array_join(F.transform("xs", lambda x: x["line"]), sep), F.lit(around[1])), 256).alias("digest"))


def tree_digest(df: DataFrame, line: Column, leaves: int = 1024) -> DataFrame:
    """One row (rows, digest) for a table of any size: the lines' hashes are summed per hash bucket before the shuffle, whatever their order, and the buckets' sums hashed."""
    h = df.select(F.sha2(line, 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    b = h.groupBy(F.pmod(F.xxhash64("h"), F.lit(leaves)).alias("b")).agg(F.count("*").alias("n"), *(F.sum(part(i)).alias(f"s{i}") for i in range(5)))
    leaf = F.concat_ws(":", "b", "n", *(f"s{i}" for i in range(5)))
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("digest"))


def document_digest(df: DataFrame, line: Column, order: Sequence[Column]) -> DataFrame:
    """One row (digest): SHA-256 of all lines in order as one JSON array. For tables that are one document: the array is made in one task."""
    return digest(df, line, order, sep=",", around=("[", "]"))
