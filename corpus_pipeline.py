"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's documents.

Every stage sees all that its predecessor kept, and all but the last keep the columns of the table, whatever their names. Stages that reject
rows decide by a key of every row: its doc_id, or where ids are missing or repeated, its number in the order of ids (missing ones
last) and texts. Null and empty texts are no leaks, no copies and never toxic by their words; empty tables stay empty;
long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowhelm.llm import decontaminate, lines, minhash, mixing, toxicity
from flowhelm.llm.columns import KEY, put_back, set_aside, with_row_keys
from flowhelm.plans.lookup import keep_matching
from flowhelm.session import prepare, store_result, stored

NEEDED = ("doc_id", "text")

def _without(named: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose key isn't among those in ``gone``."""
    left = keep_matching(named, stored(gone.select(KEY).distinct(), "rejected"), KEY, KEY, "left_anti")
    return put_back(left, names, NEEDED)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    inner = set_aside(docs, NEEDED)
    model = toxicity.fit(inner, toxicity.training_rows(labels))
    return put_back(toxicity.score(inner, model).where(F.col("toxicity") < toxicity.THRESHOLD), docs.columns, NEEDED)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds."""
    needed = (*NEEDED, "n_chars")
    cut = lines.dedup_lines(set_aside(docs, needed))
    return put_back(cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs.columns, needed)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; of rows that share it, the first by text."""
    named, _ = with_row_keys(set_aside(docs, NEEDED))
    return _without(named, minhash.keyed_components(named).where("NOT kept"), docs.columns)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    named, _ = with_row_keys(set_aside(docs, NEEDED))
    texts = named.select(F.col(KEY).alias("doc_id"), "text")
    leaks = decontaminate.leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(named, leaks.withColumnRenamed("doc_id", KEY), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each time a document is used."""
    return mixing.mix(docs)


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("toxicity", _prepared(reject_toxic)),
    ("line_dedup", _prepared(drop_repeated_lines)),
    ("minhash_near_dedup", _prepared(drop_near_copies)),
    ("decontamination", _prepared(reject_leaks)),
    ("mixing", _prepared(mix_sources)),
]
#: Classifier, signatures and embeddings can't be written in SQL; tests/llm/test_pipeline.py checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. Each stage's table goes when the next one is written, so only the last one stays in the shared folder."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = store_result(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, spark, [path] if path else [])
    return docs
