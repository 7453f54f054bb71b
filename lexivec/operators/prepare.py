"""Corpus preparation: fallback definition, model text, renames, computed columns and links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The series columns and their corpus names.
SERIES_NAMES = {"Series Code": "code", "Indicator Name": "name"}

# Addresses built from a series code.
LINK_FORMATS = {
    "page_url": "https://data.worldbank.org/indicator/%s",
    "metadata_url": "https://api.worldbank.org/v2/sources/2/series/%s/metadata?format=json",
    "chart_url": "https://data.worldbank.org/share/widget?indicators=%s&locations=1W&start=1984&view=chart",
}


def with_definition(
    df: DataFrame, long: str = "Long definition", short: str = "Short definition", name: str = "definition"
) -> DataFrame:
    """The long definition, or the short one where the long is null."""
    return df.withColumn(name, F.coalesce(F.col(long), F.col(short)))


def compose_text(name: Column, definition: Column) -> Column:
    """Name, blank line, definition; null when either is null."""
    return F.concat(name, F.lit("\n\n"), definition)


def rename_select(df: DataFrame, names: Mapping[str, str] = SERIES_NAMES, columns: list[str] | None = None) -> DataFrame:
    renamed = df.withColumnsRenamed(dict(names))
    return renamed.select(*columns) if columns else renamed


def extend_record(df: DataFrame, computed: Mapping[str, Column], keep_existing: bool = False) -> DataFrame:
    """Add computed columns; on equal names the computed one wins, or the existing one on request."""
    if keep_existing:
        computed = {n: c for n, c in computed.items() if n not in df.columns}
    return df.withColumns(dict(computed))


def with_links(df: DataFrame, code: str = "code", formats: Mapping[str, str] = LINK_FORMATS) -> DataFrame:
    return df.withColumns({name: F.format_string(form, F.col(code)) for name, form in formats.items()})
