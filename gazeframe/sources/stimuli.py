"""Stimulus tables to records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe.sources.schemas import (
    PRACTICE_COLUMNS,
    PRACTICE_UNDERSCORED,
    STIMULUS_COLUMNS,
    STIMULUS_UNDERSCORED,
)


def read_stimuli(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = STIMULUS_COLUMNS,
    line_sep: str | None = None,
) -> DataFrame:
    """Stimulus CSV by column position; the file's own header is dropped unread.

    Header names differ between the lists and one is misspelt, so only the
    position counts. ``line_sep`` is ``"\\r"`` for the practice table.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.csv(path)


def read_practice(spark: SparkSession, path: str) -> DataFrame:
    return read_stimuli(spark, path, PRACTICE_COLUMNS, line_sep="\r")


def tidy_stimuli(
    df: DataFrame,
    columns: Sequence[str] = STIMULUS_COLUMNS,
    underscored: Sequence[str] = STIMULUS_UNDERSCORED,
) -> DataFrame:
    """Spaces to ``_`` in picture names, trailing white space off the last column."""
    out = []
    for name in columns:
        value = F.col(name)
        if name in underscored:
            value = F.replace(value, F.lit(" "), F.lit("_"))
        if name == columns[-1]:
            value = F.regexp_replace(value, r"\s+$", "")
        out.append(value.alias(name))
    return df.select(*out)


def tidy_practice(df: DataFrame) -> DataFrame:
    return tidy_stimuli(df, PRACTICE_COLUMNS, PRACTICE_UNDERSCORED)


def to_records(df: DataFrame, out: str = "record") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_records(df: DataFrame, path: str) -> None:
    df.write.json(path)
