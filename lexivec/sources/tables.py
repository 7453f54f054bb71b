"""Readers and writers for the series table, the corpus and the definition lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.operators.checks import duplicate_ids

SERIES = T.StructType(
    [
        T.StructField("Series Code", T.StringType()),
        T.StructField("Indicator Name", T.StringType()),
        T.StructField("Long definition", T.StringType()),
        T.StructField("Short definition", T.StringType()),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; the schema is read from the files only where none is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_series(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = SERIES) -> DataFrame:
    """The series table from CSV (header, quoted line breaks) or Parquet.

    Quoted line breaks make a CSV file unsplittable, so a large table should come
    as many CSV files or as Parquet. CSV columns are matched by position, and the
    header is checked against the schema.
    """
    if fmt == "parquet":
        return read_table(spark, path, schema)
    if fmt != "csv":
        raise ValueError(f"unsupported series format: {fmt}")
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, escape='"', enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )


def read_corpus(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = CORPUS) -> DataFrame:
    """Corpus records from JSON arrays (`json`), JSON Lines (`jsonl`) or Parquet.

    A JSON array is one task's work however large the file, so it suits exchange
    with other tools; `jsonl` and Parquet split.
    """
    if fmt == "parquet":
        return read_table(spark, path, schema)
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"unsupported corpus format: {fmt}")
    return spark.read.schema(schema).options(multiLine=fmt == "json", mode="FAILFAST").json(path)


def write_corpus(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "errorifexists") -> None:
    """Corpus records as JSON Lines or Parquet, one file per task."""
    records = df.select(*CORPUS.fieldNames())
    writer = records.write.mode(mode)
    if fmt == "jsonl":
        # Null fields are written out, so that every record has every field.
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported corpus format: {fmt}")


def definition_lookup(df: DataFrame, key: str = "code", value: str = "definition") -> DataFrame:
    """The two-column lookup table."""
    return df.select(key, value)


def write_lookup(
    df: DataFrame, path: str, key: str = "code", value: str = "definition", mode: str = "errorifexists"
) -> None:
    """The lookup table as Parquet; an error when a key occurs twice."""
    repeated = duplicate_ids(df, key).limit(5).collect()
    if repeated:
        raise ValueError(f"lookup key {key!r} is not unique: {[r[0] for r in repeated]}")
    definition_lookup(df, key, value).write.mode(mode).parquet(path)


def name_and_definition(df: DataFrame, text: str = "text") -> DataFrame:
    """Split a text into its first line (`name`) and the remainder (`definition`)."""
    cut = F.instr(text, "\n")
    return df.withColumns(
        {
            "name": F.substring_index(text, "\n", 1),
            "definition": F.when(cut > 0, F.substring(F.col(text), cut + 1, F.length(text))).otherwise(F.lit("")),
        }
    )
