"""A training-data pipeline over ``documents``: quality, near duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes what a stage
returns as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm import jaccard, mixing, packing, private, quality
from gazeframe.llm.components import written
from gazeframe.llm.tokens import default_path
from gazeframe.operators.relational import settle
from gazeframe.session import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    # Settled, so that the filter does not work the verdict out a second time.
    assessed = quality.assess(docs, labels).select(*COLUMNS, "kept")
    return settle(assessed, {"kept": F.col("kept")}).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles hang together at 0.8: that with the smallest id.

    Repeated rows of one id count as one document; rows without id are kept.
    """
    prepare(spark)
    found = jaccard.classes(docs.select("doc_id", "text"), length=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with numbers, dates, addresses and secrets replaced, and ``n_chars`` to match."""
    prepare(spark)
    changed = private.protect(docs.select(*COLUMNS), private.configured_key(spark))
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix deals them: every one at least once, none more than twice."""
    prepare(spark)
    return mixing.mixture(docs.select(*COLUMNS), most_epochs=2.0, keep_all=True).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 4,096."""
    prepare(spark)
    return packing.pack_documents(docs, default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pseudonyms),
    ("mixing sources to target weights", source_mix),
    ("packing", packed),
]

#: Quality scores, set joins and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir.rstrip("/")), f"stage-{name.replace(' ', '-')}")
    return docs
