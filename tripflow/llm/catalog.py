"""The registered queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.llm import chat, decontam, filter_audit, hard_negatives, kneser_ney, langid, mixing, oracles, sharding, substrings, tagpath, vamana, zipwarc
from tripflow.llm.common import id_remainder, unsigned_crc32
from tripflow.llm.simhash import fingerprint_hex, near_duplicates
from tripflow.sources.staging import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagpath.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


def op2_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = settle(vamana.valid_vectors(_table(spark, sf_dir, "embeddings")), "vectors")
    return vamana.nearest(valid, valid.where("vec_id % 20 = 0"), k=20)


def op3_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = zipwarc.archive(_table(spark, sf_dir, "pages"))
    # A task a package: the list is short and each package is megabytes of reading.
    paths = packages.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    read = zipwarc.read_packages(paths, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict_column(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", size.alias("size"), unsigned_crc32(text).alias("text_crc32")
    )
    placed = sharding.shard(settle(rows, "rows"), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    )
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    scored = kneser_ney.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = rows.unionByName(planted).withColumn("content", chat.text_parts(F.col("text")))
    chats = chat.format_chats(turns).select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    listed = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = settle(docs.drop("text"), "sized")
    mixed = mixing.mix(rows, seed_columns=("doc_id", "text_hash"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    found = hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit_filters(docs, _table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
