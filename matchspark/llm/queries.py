"""The registered queries of this subpackage, each an operator over its whole table, and their SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hard_negatives, hashing_search, language_id, mixing, orc_tokens, quality, secret_scan, sharding, simhash, spelling, toxicity
from .common import crc32_of, held_out, shared_dir, table
from .oracles import SQL as ORACLES  # noqa: F401

SHARDS, NEIGHBOURS = 8, 20


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), crc32_of(F.col("text")).alias("text_crc32"))
    placed = sharding.assign(sharding.assign(rows, ["doc_id"], SHARDS), ["doc_id"], SHARDS + 1, "grown_shard")
    return sharding.numbered(placed.withColumn("law", F.lit("key"))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)],
                        F.sha2(secret_scan.named(base, secret_scan.RULES), 256).alias("base_sha256"),
                        secret_scan.named(F.col("spans"), secret_scan.RULES).alias("spans"))


def op4_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                             (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    orc_tokens.write_tokens(docs, path)
    return orc_tokens.token_index(spark, path)


def op6_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.formatted(chat.event_log(turns.unionByName(extra))))


def op7_bktree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.max("share").alias("share"))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, space).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hashing_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), NEIGHBOURS)


def op11_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, slip_every=199)
    return spelling.variants(words, ratio=5)


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0, scale=256, positives=5, negatives=5, share=(80, 100))


def op13_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_id.kept_from_training(F.col("doc_id"))
    return language_id.predicted(docs, language_id.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (
    op1_jump_sharding, op2_flow_mixing, op3_trigram_secrets, op4_bigru_toxicity, op5_orc_tokens, op6_event_chat,
    op7_bktree_simhash, op8_template_decontamination, op9_neighbour_quality, op10_multi_index_search,
    op11_pivotal_spelling, op12_residue_negatives, op13_bayes_language)}
