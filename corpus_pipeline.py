"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and is written as Parquet
and read again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import cotrain, decontaminate, jaccard, packing, repeats
from foliospark.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near duplicates share this part of their runs of five words.
SHINGLE, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; without labels, all."""
    judged = cotrain.classify(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return jaccard.keep_one(docs.select(*COLUMNS), SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what documents with smaller ids say already; n_chars follows."""
    return repeats.remove_repeats(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS),
                                           _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Learned models, suffix arrays and tokenizers are beyond SQL; tests compare each stage with a
#: brute-force version, but for quality, of which they want clean documents kept and bad ones gone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
