"""Documents to training sequences in five stages; each works on all that the one before it kept.

Part of the subpackage `llm`. A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import common, exact, mixing, packing, quality, simhash
from logloom.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what `quality` predicts as bad, each row judged by its own text.

    Null and empty texts are judged like any text, and so are repeated ids and null ids, row by row; where no document
    has a label to learn from, all rows stay; an empty table gives an empty one; columns of any name are kept.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z lowered, null like empty): that with the largest id, a null id only without another.

    Rows with one id and text are one row after it; an empty table gives an empty one; columns of any name are kept.
    """
    return exact.keep_one(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more of five-word shingles: the smallest id.

    Texts of fewer words are one shingle, those without words are alike; null ids come last; of rows with one id and
    text one stays; an empty table gives an empty one; columns of any name are kept.
    """
    return simhash.keep_one(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, sources weighing 1, 2, 3 by name (null last), three times at most.

    A text without words (null, empty) has size 0 and comes as often as its source's whole epochs and its place in the
    seeded order say; an empty table gives an empty one; columns of any name are kept.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a copy that mixing made is a document of its own, null text is the end id alone.

    An empty table gives an empty result; other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [("quality", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
