"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the
last returns the pieces of the packed sequences.  Whole texts are read, however long; rows that repeat are rows of
their own until the near stage, which leaves one; null ids take part; columns beyond those of documents are carried,
whatever their names; an empty table gives an empty result (the operators' docstrings say more).  SQL cannot express the classifier, the sketches and the tokenizer,
so ORACLE_SQL is None and tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import near_dedup, packing, quality_classifier, quality_rules
from plumbline.llm.common import ensure_checkpoint_dir, table
from plumbline.llm.queries import tokenizer

#: Near-duplicates of this stage: five words, 80 per cent; 36 bands miss such a pair with a probability below 1e-6.
NEAR = near_dedup.NearParams(shingle=5, threshold=80, bands=36)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a fence of their language and source rejects; null and blank texts go."""
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, learnt from labelled raw documents, takes for good ones; without labels none."""
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by word 5-shingles at a similarity of 0.8; rows without words stay."""
    return near_dedup.filter_documents(docs, NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a null text is its closing token alone."""
    # workers that the stages before have used get less room for strings than where packing runs alone
    return packing.pack(docs, packing.PackParams(tokenizer("word_bpe_49k.json"), cached=300_000))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet beside the checkpoints and read again.

    What the next stage has read and replaced is removed; the last table stays, as the result is computed from it.
    """
    ensure_checkpoint_dir(spark)
    folder, jvm = spark.sparkContext.getCheckpointDir(), spark.sparkContext._jvm
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{name}-{jvm.java.util.UUID.randomUUID()}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                old = jvm.org.apache.hadoop.fs.Path(last)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
            last = path
    return docs
