"""Artifact catalog: facts of files and tables, recorded against computed digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_digests(recorded: DataFrame, computed: DataFrame, id: str = "artifact") -> DataFrame:
    """(artifact, recorded, computed, state): match, drift, missing (no file) or unrecorded."""
    j = recorded.select(id, F.col("digest").alias("recorded")).join(computed.select(id, F.col("digest").alias("computed")), id, "full")
    return j.withColumn("state", F.when(F.col("recorded").isNull(), "unrecorded").when(F.col("computed").isNull(), "missing").when(F.col("recorded") == F.col("computed"), "match").otherwise("drift"))


def json_keys(df: DataFrame, text: str) -> DataFrame:
    """(key, n): top-level keys of JSON objects; other texts have none."""
    return df.select(F.explode(F.json_object_keys(text)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def gates_passed(checks: str) -> object:
    """Column: whether all values of a map of checks are true; false for an empty or missing map."""
    return F.coalesce((F.size(checks) > 0) & F.forall(F.map_values(checks), lambda v: v), F.lit(False))


def table_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, columns): rows and sorted column names of each table, "a, b, c"; the counts come from file footers where the format has them."""
    from functools import reduce

    parts = [d.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(", ".join(sorted(d.columns))).alias("columns")) for t, d in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def file_key(df: DataFrame) -> str:
    """Key of the files that a table is read from: paths, sizes and times. It changes when a file does."""
    m = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return m.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*m.columns)))), "\n"), 256)).first()[0]  # a row per file


class FileCache:
    """Tables kept in memory until one of their files changes."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[str, DataFrame]] = {}

    def get(self, name: str, read) -> DataFrame:
        d = read()
        key = file_key(d)
        if name in self.held and self.held[name][0] == key:
            return self.held[name][1]
        if name in self.held:
            self.held[name][1].unpersist()
        self.held[name] = (key, d.cache())
        return self.held[name][1]


def report_states(found: DataFrame, registered: list[str]) -> DataFrame:
    """(report, state): of registered reports whether the file (report, body) is there and holds a JSON object: ok, broken or missing. Others are unknown."""
    spark = found.sparkSession
    r = spark.createDataFrame([(x,) for x in registered], "report string").withColumn("__r", F.lit(True))  # a list in the code
    j = found.select("report", "body").join(F.broadcast(r), "report", "full")
    state = F.when(F.col("__r").isNull(), "unknown").when(F.col("body").isNull(), "missing").when(F.json_object_keys("body").isNull(), "broken").otherwise("ok")
    return j.select("report", state.alias("state"))
