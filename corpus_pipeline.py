"""The corpus pipeline: documents through five stages, each written and read again.

1. quality: rejected documents go, failing lines of the others go;
2. near_duplicates: one document of each group of like texts stays, the one of the
   least doc_id (five-word shingles, similarity 0.8 or more). Texts are compared,
   not ids: rows without a doc_id, and different texts of one, are documents of
   their own. Rows without an id come last in their group, ties go by the
   text's digest;
3. personal_data: entities are replaced by surrogates;
4. mixing: a document stands as often as the mix takes it;
5. tokens: ids of every row, encoded and decoded, as counts and digests.

All stages but the last return the columns of documents. No SQL says the whole;
tests compare it with a plain Python version.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfield import ship
from pairfield.llm.bpe import encode
from pairfield.llm.common import saved, vocabulary, word_array
from pairfield.llm.mixing import mix
from pairfield.llm.ngram_join import jaccard_groups, text_key
from pairfield.llm.pii import pseudonymise
from pairfield.llm.quality import judge
from pairfield.llm.queries import run_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines. Null and empty texts go; repeated rows are judged one by one; other columns go."""
    judged = judge(docs, keep=("doc_id", "lang", "source"))
    return _documents(judged.where("kept").withColumnRenamed("clean_text", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of like texts: the least of (has an id, doc_id, text digest, other columns). Texts without words are alone: repeated rows of one id stay once, rows without an id all stay. Other columns go."""
    docs = docs.select(*COLUMNS)
    rows = docs.withColumn("__key", text_key(docs))
    groups = jaccard_groups(rows, key="__key", gram=5, percent=80).select(F.col("doc_id").alias("__key"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__group"))
    slim = rows.select("__key", F.col("doc_id").isNull().alias("last"), "doc_id", F.md5("text").alias("digest"), *OTHERS).distinct()
    own = F.struct("last", "doc_id", "digest", *OTHERS, "__key")
    best = slim.join(groups.where("__group IS NOT NULL").distinct(), "__key").groupBy("__group").agg(F.min(own).alias("s")).select("s.__key", "s")
    same = [F.col(c).eqNullSafe(F.col(f"s.{c}")) for c in ("doc_id", *OTHERS)]
    found = rows.join(best, "__key").where(reduce(and_, same)).dropDuplicates(["__key"])
    # texts without words are like no other
    wordless = docs.where(F.size(word_array(F.col("text"))) == 0)
    return found.select(*COLUMNS).unionByName(wordless.where("doc_id IS NOT NULL").distinct().unionByName(wordless.where("doc_id IS NULL")).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with surrogates in its text. Null texts stay null; other columns go."""
    return _documents(pseudonymise(docs.select(*COLUMNS), run_key(spark)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times. Rows without words stay once; a null source is one of its own; other columns go."""
    mixed = mix(docs.select(*COLUMNS).withColumn("size", F.size(word_array(F.col("text"))).cast("long")))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; null texts count as empty."""
    return encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
