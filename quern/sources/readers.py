"""Sources with the tolerance each one needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, *, missing: str = "error") -> DataFrame:
    """Strict: blank lines are skipped, a malformed one fails the query. A missing file fails, or with missing="empty" has no rows."""
    if missing == "empty" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines with a ``_corrupt_record`` column: the line where it isn't an object, else null. Count or drop them as needed."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def map_table(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of strings as rows (key, value)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def dirty_csv(spark: SparkSession, path: str, list_columns: str | None = None) -> DataFrame:
    """CSV whose headers have blanks around them; columns that start with ``list_columns`` and a number become one array without empty cells."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    d = reduce(lambda x, c: x.withColumnRenamed(c, c.strip()), d.columns, d)
    if list_columns:
        many = [c for c in d.columns if c.lower().startswith(list_columns.lower())]
        cells = F.filter(F.transform(F.array(*(F.col(f"`{c}`") for c in many)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
        d = d.withColumn(f"{list_columns.lower()}s", cells).drop(*many)
    return d


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def records_in_text(df: DataFrame, text: str, start: str, fields: dict[str, str], overrides: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One row per record of a free text: cut before each match of ``start``, each field by the first group of its pattern. With overrides those rows win by key; otherwise the first row of a key."""
    parts = df.select(F.posexplode(F.split(text, f"(?={start})")).alias("position", "record")).where(F.col("record").rlike(start))
    out = parts.select("position", *(F.nullif(F.trim(F.regexp_extract("record", p, 1)), F.lit("")).alias(n) for n, p in fields.items()))
    if key:
        out = out.groupBy(key).agg(*(F.min_by(n, "position").alias(n) for n in ("position", *(f for f in fields if f != key))))
        if overrides is not None:
            out = out.join(overrides.select(key), key, "left_anti").unionByName(overrides, allowMissingColumns=True)
    return out


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, modified) of raw files."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def read_through(requests: DataFrame, cache: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) by the hash of the request's canonical JSON against a cache (key, content)."""
    k = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    r = requests.withColumn("key", k)
    return r.join(cache, "key"), r.join(cache, "key", "left_anti")


def settings(text: str) -> dict[str, str]:
    """KEY=VALUE lines: blank ones, comments and lines without = are skipped, quotes around a value go, the first of a repeated key stays."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and key.strip() and not key.startswith("#"):
            value = value.strip()
            out.setdefault(key.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value)
    return out


def first_keys(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first line of a JSON-lines file that holds an object, sorted; none without one."""
    r = spark.read.text(path).select(F.json_object_keys("value").alias("k")).where("k is not null").limit(1).collect()
    return sorted(r[0]["k"]) if r else []


def language_sample(df: DataFrame, text: str, corrupt: str, wanted) -> tuple[DataFrame, dict[str, int]]:
    """Rows that are objects, in the language, with a text; and how many were skipped for each reason."""
    bad, w = F.col(corrupt).isNotNull(), F.coalesce(wanted, F.lit(False))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    n = df.agg(F.count_if(bad).alias("no_object"), F.count_if(~bad & ~w).alias("language"), F.count_if(~bad & w & blank).alias("blank")).first()
    return df.where(~bad & w & ~blank).drop(corrupt), n.asDict()
