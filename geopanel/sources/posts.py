"""Post dumps, delimited tables and saved tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dump format. A record ends with a tab, the digit 1 and a line
# feed; 17 fields must remain. Field positions are 0-based.
RECORD_END = "\t1\n"
FIELD_COUNT = 17
TEXT, ID, USERNAME, GEO, COORD_1, COORD_2, TIMESTAMP = 0, 3, 7, 9, 10, 11, 16
EMBEDDED_JSON = r"\{[^}]*\}"

POSTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("geo_available", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ]
)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw dump, one row per record in column ``value``; records may span lines."""
    return spark.read.option("lineSep", RECORD_END).text(path)


def record_fields(raw: Column) -> Column:
    """Fields of one record, after cutting embedded JSON (only if the record has tabs)."""
    cleaned = F.when(raw.contains("\t"), F.regexp_replace(raw, EMBEDDED_JSON, "")).otherwise(raw)
    return F.split(cleaned, "\t", -1)


def parse_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    """Records with the right number of fields, as the six post columns (all text)."""
    fields = raw.select(record_fields(F.col(column)).alias("f")).where(F.size("f") == FIELD_COUNT)

    def at(i: int) -> Column:
        return F.element_at("f", i + 1)

    return fields.select(
        at(ID).alias("id"),
        F.translate(at(USERNAME), "|", ",").alias("username"),
        at(TIMESTAMP).alias("timestamp"),
        F.translate(at(TEXT), "|", ",").alias("text"),
        at(GEO).alias("geo_available"),
        F.concat_ws(" ", at(COORD_1), at(COORD_2)).alias("coordinates"),
    )


def parse_rejects(raw: DataFrame, column: str = "value") -> DataFrame:
    """How many records were accepted and rejected, by number of fields."""
    size = F.size(record_fields(F.col(column))).cast("long")
    return (
        raw.select(size.alias("n_fields"))
        .groupBy("n_fields")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("accepted", F.col("n_fields") == FIELD_COUNT)
    )


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", header: bool = True, multi_line: bool = True
) -> DataFrame:
    """Delimited table with doubled quotes; no inference.

    ``multi_line`` allows line breaks inside quotes, and then a file is one
    task. Turn it off for tables without them: their files are split.
    """
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_raw_posts(raw: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    """Write records as a dump that :func:`read_raw_posts` reads back."""
    raw.select(column).write.mode(mode).option("lineSep", RECORD_END).text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "|", mode: str = "errorifexists") -> None:
    """Write a delimited table that :func:`read_delimited` reads back unchanged."""
    (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Save an intermediate table as parquet, partitioned (by date, as a rule).

    With partition columns the rows are rebalanced on them: adaptive execution
    splits a date by its size, so it is written by as many tasks as it needs.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
