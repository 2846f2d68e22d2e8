"""The registered queries of this subpackage and, where SQL can say them, their oracle."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, vocabulary, word_array
from .sql import ORACLE as ORACLE


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_groups

    return jaccard_groups(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import chosen, half_replaced, hashes, likeness, shown, with_next

    docs = with_next(documents(spark, sf_dir)).withColumn("edited", half_replaced(F.col("text"), F.col("next_text")))
    # explode of one struct: each fingerprint is worked out once
    made = docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(chosen(F.col("text")).alias("a"), chosen(F.col("edited")).alias("b"), chosen(F.col("next_text")).alias("c")))).alias("f"),
    )
    sets = made.select("*", F.explode(F.array(F.struct(hashes(F.col("f.a")).alias("a"), hashes(F.col("f.b")).alias("b"), hashes(F.col("f.c")).alias("c")))).alias("h"))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("f.a")).alias("fingerprint"), shown(F.col("f.b")).alias("edited_fingerprint"),
        likeness(F.col("h.a"), F.col("h.b")).alias("near_edited"), likeness(F.col("h.a"), F.col("h.c")).alias("near_next"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, sf_dir)).drop("clean_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"), "removed", "n_repeated")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "removed", "n_repeated")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    sized = documents(spark, sf_dir).select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"))
    mixed = mix(saved(sized, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret in pairfield.surrogates.key. Only a local session may do without one: what it makes can be reversed by whoever reads this line."""
    key = spark.conf.get("pairfield.surrogates.key", None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError("pairfield.surrogates.key must hold a secret")
    return (key or "not a secret").encode()


#: Secrets of applications on a cluster that name none.
_drawn: dict[str, bytes] = {}


def run_key(spark: SparkSession) -> bytes:
    """The key of surrogate_key; on a cluster without one a secret drawn for the application, so that surrogates agree inside it, and nobody can reverse or repeat them."""
    try:
        return surrogate_key(spark)
    except ValueError:
        return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), run_key(spark))


def op9_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_tokens import read_blocks, token_files

    return read_blocks(token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, write_flat

    return count_tokens(write_flat(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, number, scan, shown

    found = F.col("secrets")
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *[number(found, k).alias(f"n_{k}") for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(found).alias("spans"), (F.size(found) - F.size(base)).cast("long").alias("n_checked")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked

    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_suffix_dedup, op4_mixing, op5_ngram_jaccard, op6_fingerprints, op7_quality_rules, op8_pii_surrogates, op9_binary_tokens, op10_token_counts, op11_secret_scan, op12_prefix_trie, op13_ranked_search)}
