"""Encoding of texts to vectors, and the check that two encodings agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.text import tokenize
from lexivec.functions.vectors import dot

# Called once per task; returns a function from texts to one vector per text.
EncoderFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]

# Fixed value: two encodings of a text agree when their dot product exceeds this.
PARITY_LIMIT = 0.99


def embed(df: DataFrame, text: str, factory: EncoderFactory, vector: str = "embedding") -> DataFrame:
    """Encode a text column with a model of the user's. Null texts get a null vector."""
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for batch in batches:
            given = batch[text].notna().to_numpy()
            vectors = np.full(len(batch), None, dtype=object)
            if given.any():
                encoded = encoder(batch[text][given].tolist())
                for place, values in zip(np.flatnonzero(given), encoded, strict=True):
                    vectors[place] = np.asarray(values, dtype=np.float64)
            yield batch.assign(**{vector: vectors})

    return df.mapInPandas(encode, schema)


def embed_hashed(df: DataFrame, text: str, width: int = 256, vector: str = "embedding") -> DataFrame:
    """A stand-in for a model that needs no Python: unit vectors of hashed word counts."""
    words = df.withColumn("_words", F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")))
    counted = HashingTF(numFeatures=width, inputCol="_words", outputCol="_counts").transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn(vector, vector_to_array("_unit")).drop("_words", "_counts", "_unit")


def embedding_parity(
    first: DataFrame, second: DataFrame, key: str = "id", vector: str = "vector", limit: float = PARITY_LIMIT
) -> DataFrame:
    """Compare two encodings of the same texts: number of pairs, least dot product, pairs at or under the limit."""
    pairs = first.select(key, F.col(vector).alias("_a")).join(second.select(key, F.col(vector).alias("_b")), key)
    return pairs.select(dot(F.col("_a"), F.col("_b")).alias("sim")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.min("sim").alias("min_sim"),
        F.count_if(F.col("sim") <= F.lit(limit)).alias("failed"),
    )
