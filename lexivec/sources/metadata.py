"""Nested document metadata: schema, reader and flat views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _list(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType(_texts(*names)))


METADATA = T.StructType(
    [
        *_texts("type"),
        T.StructField(
            "metadata_information",
            T.StructType(
                [
                    *_texts("title", "idno"),
                    T.StructField("producers", _list("name", "abbr", "affiliation", "role")),
                    *_texts("production_date", "version"),
                ]
            ),
        ),
        T.StructField(
            "document_description",
            T.StructType(
                [
                    T.StructField(
                        "title_statement",
                        T.StructType(_texts("idno", "title", "sub_title", "alternate_title", "translated_title")),
                    ),
                    T.StructField(
                        "authors", _list("first_name", "initial", "last_name", "affiliation", "full_name")
                    ),
                    *_texts("date_created", "date_available", "date_published"),
                    T.StructField("identifiers", _list("type", "identifier")),
                    *_texts("type", "abstract"),
                    T.StructField("ref_country", _list("name", "code")),
                    *_texts("spatial_coverage"),
                    T.StructField("languages", _list("name", "code")),
                    *_texts("volume", "number", "url"),
                    T.StructField("contacts", _list("name", "affiliation", "email", "uri")),
                    *_texts("usage_terms", "disclaimer", "security_classification"),
                    T.StructField("keywords", _list("id", "name", "vocabulary")),
                    T.StructField("themes", T.ArrayType(T.StringType())),
                    T.StructField(
                        "reproducibility",
                        T.StructType([*_texts("statement"), T.StructField("links", _list("uri", "description"))]),
                    ),
                    *_texts("pricing"),
                ]
            ),
        ),
        T.StructField(
            "provenance",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "origin_description",
                            T.StructType(
                                [
                                    *_texts("harvest_date"),
                                    T.StructField("altered", T.BooleanType()),
                                    *_texts("base_url", "identifier", "date_stamp", "metadata_namespace"),
                                ]
                            ),
                        )
                    ]
                )
            ),
        ),
        *_texts("schematype"),
    ]
)

IDNO = "document_description.title_statement.idno"


def read_metadata(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per metadata file, or per line without `multi_line`: large collections are split only by lines."""
    return spark.read.schema(METADATA).options(multiLine=multi_line, mode="FAILFAST").json(path)


def _or_null(column: str) -> Column:
    # Empty strings mark missing values in these files.
    return F.nullif(F.col(column), F.lit(""))


def metadata_documents(df: DataFrame) -> DataFrame:
    """One row per document, with its dates parsed."""
    description = "document_description"
    origin = F.get("provenance", F.lit(0))["origin_description"]

    def day(column: str) -> Column:
        return F.to_date(_or_null(column), "yyyy/MM/dd")

    return df.select(
        F.col(IDNO).alias("idno"),
        F.col(f"{description}.title_statement.title").alias("title"),
        _or_null(f"{description}.abstract").alias("abstract"),
        F.col(f"{description}.type").alias("document_type"),
        day("metadata_information.production_date").alias("production_date"),
        day(f"{description}.date_created").alias("date_created"),
        day(f"{description}.date_available").alias("date_available"),
        day(f"{description}.date_published").alias("date_published"),
        F.to_date(F.nullif(origin["harvest_date"], F.lit(""))).alias("harvest_date"),
        F.to_timestamp(F.nullif(origin["date_stamp"], F.lit(""))).alias("date_stamp"),
        origin["altered"].alias("altered"),
    )


def metadata_items(df: DataFrame, field: str) -> DataFrame:
    """One row per item of a list of the description, such as `keywords`, `authors` or `identifiers`.

    Documents with an empty list keep one row of nulls.
    """
    items = df.select(F.col(IDNO).alias("idno"), F.explode_outer(f"document_description.{field}").alias("item"))
    if isinstance(items.schema["item"].dataType, T.StructType):
        return items.select("idno", "item.*")
    return items


def explode_json(df: DataFrame, key: str, column: str, schema: str = "map<string,string>") -> DataFrame:
    """One row per entry of a JSON object held in a string column."""
    return df.select(key, F.explode_outer(F.from_json(F.col(column), schema)).alias("name", "value"))
