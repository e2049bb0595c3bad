"""From raw documents to a training mixture: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equivcheck.llm import decontaminate, mixing, pseudonyms, quality, simhash
from equivcheck.llm.common import table, unused
from equivcheck.llm.queries import WEIGHTS, levels
from equivcheck.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text and its length, in the same columns."""
    changed = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the failing lines go."""
    # The row travels whole, so that columns of the judge's names stay what they are.
    judged = quality.judge(docs.select(F.struct("*").alias("__row"), "text")).where("kept")
    clean = unused(docs, "clean")[0]
    rows = judged.select("__row.*", F.col("clean_text").alias(clean))
    return _with_text(rows, F.col(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of four words, four bits) the one with the least id stays."""
    return simhash.survivors(docs, radius=simhash.RADIUS, size=simhash.SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced by their pseudonyms."""
    replaced = pseudonyms.replace(docs, count=unused(docs, "n_pii")[0])
    return _with_text(replaced, F.col("text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: half of all tokens, by weights; a document comes once per epoch it is drawn in."""
    return mixing.mix(docs, levels(), weights=WEIGHTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii pseudonyms", pii_stage),
    ("mixing to weights", mixing_stage),
]

# Components of near copies and Feistel rounds are not written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
