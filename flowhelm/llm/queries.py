"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowhelm.llm import chat, decontaminate, fingerprint, lines, minhash, mixing, ngrams, pieces, repair, secrets, suffixes, toxicity, whitening
from flowhelm.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(mixing.SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix of all documents takes from each, by source weights 3, 1, 2."""
    return mixing.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))


@query(secrets.SQL)
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, and weak credential parts near those that complete them."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query(chat.SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    parts = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.coalesce("text", F.lit(""))))
    return chat.read_back(chat.format_turns(parts))


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


@query(lines.SQL)
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_components(table(spark, sf_dir, "documents"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, or near copies of them, in all documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), evidence=True)


@query()
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes under 100-byte strings that start earlier."""
    cut = suffixes.dedup_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under an interpolated n-gram model of the documents not held out."""
    return ngrams.score(table(spark, sf_dir, "documents"), stable=True)


@query()
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a 32k piece vocabulary, and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, drop=["text"])
    return pieces.decode(tokens, model).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the eight leading components of their covariance, each with variance one."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(repair.SQL)
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by checksum and repaired by the cheapest edits."""
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))
