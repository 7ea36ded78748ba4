"""Sinks: evolving appends, keep-first upserts, partitioned and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def evolved_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns become NULL, a column of two types takes the old type, or text where a cast would fail."""
    kinds = dict(old.dtypes)
    cast = [F.col(c).try_cast(kinds[c]).alias(c) if c in kinds and kinds[c] != t else F.col(c) for c, t in new.dtypes]
    return old.unionByName(new.select(*cast), allowMissingColumns=True)


def keep_first(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert that ignores known keys: all old rows, and per new key the least new row.  NULL keys of new rows are dropped."""
    fresh = new.where(F.col(key).isNotNull()).join(old.select(key), key, "left_anti")
    columns = [c for c in new.columns if c != key]
    one = fresh.groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return old.unionByName(one, allowMissingColumns=True)


def write_by_year(df: DataFrame, date: str, path: str) -> None:
    """Parquet partitioned by the year of an ISO date text; malformed dates go to year 0."""
    year = F.coalesce(F.substring(F.regexp_extract(F.col(date), r"^\d{4}-\d{2}-\d{2}", 0), 1, 4).try_cast("int"), F.lit(0))
    df.withColumn("year", year).write.mode("overwrite").partitionBy("year").parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header, quoted fields over several lines, explicit types; the empty field is NULL."""
    return spark.read.schema(schema).option("header", True).option("lineSep", "\n").option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "").option("emptyValue", "").csv(path)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists on its file system."""
    for path in candidates:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return path
    return None
