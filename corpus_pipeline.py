"""From documents to token shards: each stage takes all that the one before kept, written as Parquet and read again.

Edge cases: null and empty texts are rejected by the quality rules; very long texts pass through every stage whole; rows with null ids are documents like others (they link with no copy, and are kept);
different texts under one id are different documents; of rows equal in id and text one stays; ties fall to the least id, then to the text's hash; an empty table gives no rows; columns besides those of documents,
whatever their names, pass through up to the last stage.

The shared tables of a stage are deleted when the next one begins or the run ends, and no others are; the last stage's shards are kept, as its rows are read from them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, decontam, jaccard, mixing, quality, wavelet
from quire.llm.queries import read, tokenizer_path

_before: list[str] = []


def stage(make):
    """A stage, at whose beginning the tables of the stage before are deleted."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_paths(_before)
        with common.noting() as made:
            out = make(spark, docs, sf_dir)
        _before[:] = made
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.drop_paths(_before)
    return wavelet.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_shards", token_shards),
]
#: The last stage's tokenizer is beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), []
    for name, make in STAGES[:-1]:
        path = common.new_path(spark, name)
        make(spark, docs, sf_dir).write.parquet(path)
        common.drop_paths(last)
        docs, last = spark.read.parquet(path), [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.drop_paths(last)
    return out
