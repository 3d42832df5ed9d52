"""Nested participant submissions to flat trial rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_submissions(df: DataFrame, json_col: str, schema: T.StructType | str) -> DataFrame:
    """Replace a JSON text column by the fields of a declared schema."""
    others = [name for name in df.columns if name != json_col]
    return df.select(*others, F.from_json(json_col, schema).alias("_s")).select(*others, "_s.*")


def flatten_submissions(
    df: DataFrame,
    trials: str = "trials",
    prefixed: tuple[str, ...] = ("system", "subject_information"),
) -> DataFrame:
    """One row per trial; fields of each struct in ``prefixed`` repeat with its name in front.

    A submission without trials keeps one row, with NULL trial fields. A field of the submission that its trials
    have too, such as ``condition``, becomes ``submission_<name>``; the trial's keeps its name.
    """
    own = set(df.schema[trials].dataType.elementType.names)
    columns = []
    for field in df.schema.fields:
        if field.name == trials:
            continue
        if field.name in prefixed:
            columns += [
                F.col(f"{field.name}.{sub}").alias(f"{field.name}_{sub}")
                for sub in field.dataType.names
            ]
        else:
            columns.append(F.col(field.name).alias(f"submission_{field.name}" if field.name in own else field.name))
    return df.select(*columns, F.inline_outer(trials))
