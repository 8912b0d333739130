"""Row queries: optional predicates, search, lookup, export."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAYSTACKS = {"sft": ("question_vi", "reading_vi", "position_glosses"), "cards": ("name_en", "meaning_en", "meaning_vi")}
EQUAL = ("task_type", "register", "length_band", "querent_context", "spread_id")


@dataclass(frozen=True)
class RowFilter:
    """All parts that are set must hold; an unset part holds for every row."""

    task_type: str | None = None
    register: str | None = None
    length_band: str | None = None
    querent_context: str | None = None
    spread_id: str | None = None
    card_id: str | int | None = None
    orientation: str | None = None
    tier: str | None = None
    ifd_min: float | None = None
    ifd_max: float | None = None
    q: str | None = None


def _kind(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def member(df: DataFrame, many: str, one: str, value: str) -> Column:
    """Membership in an array column if there is one, whatever the element type; else equality with a scalar column."""
    if isinstance(_kind(df, many), T.ArrayType):
        return F.exists(many, lambda x: x.cast("string") == value)
    return F.col(one).cast("string") == value if one in df.columns else F.lit(False)


def in_range(score: Column, low: float | None, high: float | None) -> Column:
    """Inclusive at both ends; a null score always passes."""
    ok = [score >= low] if low is not None else []
    ok += [score <= high] if high is not None else []
    return score.isNull() | reduce(Column.__and__, ok, F.lit(True))


def search(df: DataFrame, q: str, kind: str | None = None) -> Column:
    """Substring, whatever its case, in the haystack of the kind; else in any string or array of strings. Never a pattern."""
    names = HAYSTACKS.get(kind or "") or [f.name for f in df.schema if isinstance(f.dataType, T.StringType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    present = [F.col(n) if isinstance(_kind(df, n), T.StringType) else F.array_join(n, "\0") for n in names if n in df.columns]
    return F.contains(F.lower(F.concat_ws("\0", *present)), F.lower(F.lit(q))) if present else F.lit(False)


def matching(df: DataFrame, f: RowFilter, *, kind: str | None = None, union: bool = False) -> DataFrame:
    """The conjunction as one filter, cheap parts first, so that equality and range reach the scan. Rows without a compared column, or null there, don't match; the tier counts for the union of tiers only."""
    parts = [F.col(c) == getattr(f, c) if c in df.columns else F.lit(False) for c in EQUAL if getattr(f, c) is not None]
    if f.tier is not None and union:
        parts.append(F.col("tier") == f.tier)
    if f.ifd_min is not None or f.ifd_max is not None:
        parts.append(in_range(F.col("ifd_score"), f.ifd_min, f.ifd_max) if "ifd_score" in df.columns else F.lit(True))
    if f.card_id is not None:
        parts.append(member(df, "card_ids", "card_id", str(f.card_id)))
    if f.orientation is not None:
        parts.append(member(df, "orientations", "orientation", f.orientation))
    if f.q:
        parts.append(search(df, f.q, kind))
    return df.filter(reduce(Column.__and__, parts)) if parts else df


def parse_filter(params: dict[str, str]) -> RowFilter:
    """From request parameters; unknown names and bad numbers raise ValueError."""
    known = {f.name for f in fields(RowFilter)}
    if bad := set(params) - known:
        raise ValueError(f"unknown parameters: {sorted(bad)}")
    return RowFilter(**{k: float(v) if k.startswith("ifd_") else v for k, v in params.items()})


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with the key, at most one. A key of two parts (a,b) takes a value of two parts a/b; a malformed value finds nothing."""
    names, parts = key.split(","), value.split("/", key.count(","))
    if len(names) != len(parts):
        return df.limit(0)
    return df.filter(reduce(Column.__and__, (F.col(n).cast("string") == p for n, p in zip(names, parts, strict=True)))).limit(1)


def tagged_union(parts: dict[str, DataFrame], tag: str = "tier") -> DataFrame:
    """UNION ALL with a literal tag; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn(tag, F.lit(t)) for t, d in parts.items()))


def export_lines(df: DataFrame) -> Iterator[str]:
    """Canonical JSON lines, a partition at a time in the driver."""
    from quern.functions.canonical import canonical_json

    for r in df.select(canonical_json(df).alias("line")).toLocalIterator(prefetchPartitions=True):
        yield r["line"]
