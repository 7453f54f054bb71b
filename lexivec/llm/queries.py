"""The registered queries of this folder, and their SQL where SQL can express them.

A query applies its operator to its whole table and derives the columns of its contract from the result.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import chat, decontam, langid, line_dedup, merkle, near_dup, ngram_join, packing, pii, quality, secrets, toxicity, trie
from lexivec.llm.oracles import ORACLES
from lexivec.llm.shared import BLANKS, same, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

__all__ = ["ORACLES", "QUERIES"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


@query
def op10_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words", F.size("removed_lines").cast("long").alias("n_removed_lines"),
    )


@query
def op7_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark, sf_dir):
    found = decontam.contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    # Lines are counted before the join, which then needs no text.
    found = line_dedup.dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed")["line"].cast("array<string>"), ",").alias("removed"),
    )


def _id(key: str) -> Column:
    return F.nullif(F.col(key)["id"], F.lit(line_dedup.NO_ID))


@query
def op1_line_links(spark, sf_dir):
    found = line_dedup.count_links(read(spark, sf_dir, "documents"))
    return found.select(
        _id("doc").alias("doc_id"), F.col("line").cast("long").alias("line"), _id("class_doc").alias("class_id"),
        F.col("class_line").cast("long").alias("class_line"), "n_links",
    )


@query
def op6_chat_formatting(spark, sf_dir):
    # The contract adds one conversation whose texts look like a template.
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    formatted = saved(chat.format_chats(chat.log_of(table)), "chats")
    turn = F.struct("message", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "learned")
    back = chat.read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    learned = F.array_join(F.col("t")["learned"], "")  # nulls, outside the mask, are left out
    facts = back.select(
        F.col("conv_id").alias("id"),
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.col("t")["turn"], ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
    )
    return (
        formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))
        .join(facts, same(F.col("conv_id"), F.col("id")))
        .drop("id")
    )


@query
def op3_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    # The table knows toxic or not; a toxic document that is also of low quality counts as the graver grade.
    grade = F.when(F.col("toxic") == 0, 0).otherwise(F.when(F.col("quality") == 0, 2).otherwise(1))
    model = toxicity.train(docs, labels.filter("toxic IS NOT NULL").select("doc_id", grade.alias("grade")))
    return toxicity.severity(docs, model)


@query
def op9_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = langid.learn(docs.filter(~held_out))
    return langid.identify(docs, filters).withColumn("held_out", held_out)


@query
def op5_personal_data(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train(docs))


@query
def op4_secret_scan(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("sha256"), F.round("score", 6).alias("score"), "is_secret")


@query
def op13_merkle_manifest(spark, sf_dir):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = merkle.manifest(read(spark, sf_dir, "documents"), tampered)
    proof = F.sha2(merkle.shown(F.col("siblings")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(*trie.regrafted(saved(trie.numbered_turns(read(spark, sf_dir, "conversations")), "numbered")))


@query
def op11_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))
