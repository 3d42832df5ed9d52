"""CSV and Parquet sources, CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = False,
    line_sep: str | None = None,
) -> DataFrame:
    """Headed CSV with doubled quotes, its columns in the order of ``schema``.

    ``multi_line`` is only for free text with line breaks: such files cannot be
    split between tasks.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    if multi_line:
        reader = reader.option("multiLine", True)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.csv(path)


def read_named_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool = False,
    missing: str = "NA",
) -> DataFrame:
    """Headed CSV whose columns may come in any order, matched to ``schema`` by name.

    Dots in header names become ``_``. A declared column the file lacks is NULL,
    as are ``missing`` and text that is no value of its type; other columns are
    dropped.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("nullValue", missing)
    if multi_line:
        reader = reader.option("multiLine", True)
    raw = reader.csv(path)
    found = {name.replace(".", "_"): name for name in raw.columns}
    columns = []
    for field in schema:
        value = F.col(f"`{found[field.name]}`") if field.name in found else F.lit(None)
        columns.append(value.try_cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def csv_lines(df: DataFrame, sep: str = ",", header: bool = False) -> DataFrame:
    """The rows as CSV text, one ``line`` each, for a text sink or a console; NULL is ``NA``.

    Cells with separators, quotes or line breaks are quoted, quotes in them doubled. ``header`` puts a line of the
    column names in front, in a partition of its own.
    """
    options = {"sep": sep, "nullValue": "NA", "escape": '"', "emptyValue": ""}
    cells = [F.col(f"`{name}`").cast("string").alias(f"c{i}") for i, name in enumerate(df.columns)]
    lines = df.select(F.to_csv(F.struct(*cells), options).alias("line"))
    if not header:
        return lines
    names = F.struct(*[F.lit(name).alias(f"c{i}") for i, name in enumerate(df.columns)])
    return df.sparkSession.range(1).select(F.to_csv(names, options).alias("line")).unionByName(lines)


def read_onsets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Onset dimension from CSV or Parquet, one row per audio name."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)
