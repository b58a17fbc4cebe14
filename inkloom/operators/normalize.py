"""Normalisation of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkloom.functions.layout import normalize


def normalized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, normalize(docs[text]))
