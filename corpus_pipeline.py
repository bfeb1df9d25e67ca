"""The corpus pipeline: stages of fathomweave.llm applied one after another to ``documents``.

Each stage gets what its predecessor kept, as a written table, and all but the last return its columns. An empty
table stays empty in each; null texts count as empty, null doc_id and source are values like others, repeated rows
are rows of their own but where a stage says otherwise, and further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.llm import linededup, mixing, neardup, packing, toxicity
from fathomweave.runtime import drop_table, drop_written, write_table, written_so_far


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, trained on the labelled rows of the documents; what it rejects goes (texts without a word stay, and all where one class is missing)."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 by source; every row stays, n_chars (where there is one) follows the text."""
    done = linededup.drop_boilerplate(docs, report=False)
    return done if "n_chars" not in docs.columns else done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on shingles of five words at a similarity of 0.8; one document of each group stays, that with the smallest doc_id (null last)."""
    return neardup.dedup(docs, shingle=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as its source's target asks for; null is a source."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]
#: Trained models, fingerprints and tokens are beyond SQL; tests/llm holds the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        first = written_so_far()
        docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        # what a stage wrote on its way, and what it read, is not needed any more
        drop_written(spark, first, {path})
        if before is not None:
            drop_table(spark, before)
        before = path
    return docs
