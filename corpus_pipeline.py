"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, as written to Parquet and read again. All but the last return the columns of
``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsim.llm import arrays as A
from obsim.llm import decontam, jaccard, mixing, quality, sharding
from obsim.llm.tables import documents, table
from obsim.session import scratch_path

# Hash-based draws (block order, splitters) have no counterpart in SQL, so the stages are tested by brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return jaccard.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; beyond the point where a source runs out the others go on."""
    return mixing.mixed_corpus(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; inside a shard, slots follow the order in which the mix was written.

    That order is the number of the part, of its file, and of the row in the file.
    """
    place = A.own_names(docs, "place")["place"]
    name = F.col("_metadata.file_name")
    part, file = (F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)\.", k).cast("long") for k in (1, 2))
    placed = docs.select("*", (part * (1 << 40) + file * (1 << 32) + F.col("_metadata.row_index")).alias(place))
    return sharding.shard(placed, place=place).drop(place)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged as Parquet in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
