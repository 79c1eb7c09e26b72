"""JSON lines, JSON with comments, arrivals as text, and the sinks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A string in either kind of quotes (kept), or a comment (dropped).
_COMMENT = r"""("(?:\\[\s\S]|[^"\\])*+"|'(?:\\[\s\S]|[^'\\])*+')|//[^\n]*|/\*[\s\S]*?\*/"""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: lines that aren't blank, without a byte order mark."""
    found = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return found.filter(F.trim("value") != "")


def permissive(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of the schema; lines that aren't objects, or lack a required string, are passed over."""
    rows = lines(spark, path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    for c in required:
        rows = rows.filter(F.trim(c) != "")
    return rows


def faults(spark: SparkSession, path: str, schema: str, key: str = "id", required: tuple[str, ...] = ("id",)) -> DataFrame:
    """file, value, fault: what a strict reading refuses (not an object, blank field, repeated key)."""
    full = StructType.fromDDL(schema + ", _bad string")
    parsed = lines(spark, path).withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.coalesce(F.trim(f"r.{c}"), F.lit("")) == "")
    fault = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not an object").when(blank, "blank field")
    out = parsed.withColumn("fault", fault)
    repeated = out.filter("fault is null").groupBy(F.col(f"r.{key}").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k")
    again = out.filter("fault is null").join(repeated, F.col(f"r.{key}") == F.col("_k"), "left_semi").withColumn("fault", F.lit("repeated key"))
    return out.filter("fault is not null").unionByName(again).select("file", "value", "fault")


def strict(spark: SparkSession, path: str, schema: str, key: str = "id", required: tuple[str, ...] = ("id",)) -> DataFrame:
    """As permissive(), but any fault, or no row at all, is an error that names the first files and lines."""
    bad = faults(spark, path, schema, key, required).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{b['file']}: {b['fault']}: {b['value'][:80]}" for b in bad))
    rows = permissive(spark, path, schema, required)
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows


def strip_comments(text: Column) -> Column:
    """Without // and /* */ outside strings."""
    return F.regexp_replace(text, _COMMENT, "$1")


def commented(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonc") -> DataFrame:
    """path and the schema's columns: a file is one object; folders below count, files named manifest* don't."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value").filter(~F.col("name").startswith("manifest"))
    return files.select("path", F.from_json(strip_comments(F.col("value")), schema).alias("r")).select("path", "r.*")


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """file, columns array<double>: lines of at least eight numbers; other lines (headers, counts) are passed over."""
    parts = lines(spark, path).select("file", F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") >= 8)
    rows = parts.select("file", F.transform("p", lambda x: x.try_cast("double")).alias("columns"))
    return rows.filter(F.forall(F.slice("columns", 1, 8), lambda x: x.isNotNull()))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).mode("errorifexists").csv(path)


def expand(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """path, bytes of the files that the patterns name, each once, by path; an error if one names none. Contents aren't read."""
    found = None
    for p in patterns:
        own = spark.read.format("binaryFile").load(p).select("path", F.col("length").alias("bytes"))
        if own.isEmpty():
            raise FileNotFoundError(f"{p}: no files")
        found = own if found is None else found.unionByName(own)
    return found.distinct().orderBy("path")


def by_class(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """class, path and the schema's columns of the files root/<class>/json/*.json, an object a file, comments allowed."""
    files = spark.read.text(f"{root.rstrip('/')}/*/json/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    own = F.regexp_extract("path", r"([^/]+)/json/[^/]+$", 1)
    return files.select(own.alias("class"), "path", F.from_json(strip_comments(F.col("value")), schema).alias("r")).select("class", "path", "r.*")
