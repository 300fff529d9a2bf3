"""The operators' queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.llm import chat_format, collocations, crf_quality, decontaminate, license_scan, line_dedup, merkle, mixing, near_dedup, quality_rules, sharding, token_count, url_filter
from pricescope.llm.common import WORD, ascii_lower, read
from pricescope.llm.oracles import ORACLES


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_index(read(spark, sf_dir, "documents"), shards=24)


def word_length() -> Column:
    """A document's weight in the mix grows with the length of its words: 1 at five characters a word, spaces included."""
    return F.floor(F.try_divide(F.lit(8) * F.length("text"), F.lit(5) * F.regexp_count("text", F.lit(WORD)))) / 8


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(read(spark, sf_dir, "documents"), max_copies=3, weight=word_length())
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The site rules of the contract.
URL_RULES = [
    url_filter.site_rule("allow", "com/"),
    url_filter.site_rule("block", "example.com/en/"),
    url_filter.site_rule("allow", "www.example.com/en/"),
    url_filter.site_rule("block", "net/es/"),
    url_filter.site_rule("block", "net/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = crf_quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The conversation that the contract adds.
ADDED = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(rows.unionByName(added))
    turns = formatted.select(
        "conv_id",
        chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("segments")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(read(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        F.round(best["dice"], 6).alias("best_dice"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.find_collocations(read(spark, sf_dir, "documents"), top=2000, min_count=100, percent=100)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_hash([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in fields])
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    seen = F.when(touched, changed).otherwise(merkle.leaf_hash([F.col(c) for c in fields]))
    proven = merkle.prove(merkle.build_manifest(docs, group="lang", key="doc_id", fields=fields, extra={"seen": seen}))
    folded = proven.withColumn("folded_root", merkle.folded_root(F.col("seen"), F.col("proof")))
    proof = F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_dedup.edit_lines(read(spark, sf_dir, "documents"), min_chars=10)
    return edited.select(F.col("__row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_count": op5_token_count,
    "op6_crf_quality": op6_crf_quality,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}
