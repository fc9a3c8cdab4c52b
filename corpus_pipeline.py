"""A training corpus from `documents`, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame whose rows, written as Parquet, are the next stage's docs.
All stages but the last keep the columns of `documents`: rows that a stage
rejects go, texts that it changes are replaced together with n_chars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import language
from lagloom.llm.lines import dedup_lines
from lagloom.llm.packing import pack_documents
from lagloom.llm.secret_scan import find_secrets, masked
from lagloom.llm.shared import only, scratch, small_side, with_replaced
from lagloom.llm.sketches import near_duplicates
from lagloom.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return only(with_replaced(docs, {"n_chars": F.length("text").cast("long")}), columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null or have no letter go.
    If no document carries a language, nothing is known and all with a text stay."""
    model = language.learn(docs)
    if not model["langs"]:
        return docs.where(F.col("text").isNotNull())
    predicted = language.predict(docs, model, keep_text=True)
    return only(predicted.where(F.col("lang_pred") != language.UNKNOWN), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the long lines that many documents share."""
    return _measured(dedup_lines(docs), docs.columns)


# Fixed value: numbers from here on stand for further texts under one id.
_FURTHER = 1 << 62


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest
    id. Texts under one id are documents of their own: the one with the smallest
    hash has the id, the others come after all other documents. Of rows with one
    id and one text one stays; a null id is a document of its own."""
    body = F.xxhash64("text")
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), body.alias("_body")).where("_id is not null")
    # Repeated ids are rare: only for them are rows told apart by text.
    twice = ids.groupBy("_id").agg(F.count("*").alias("n"), F.min("_body").alias("_first")).where("n > 1")
    twice = small_side(scratch(twice.select("_id", "_first"), "repeated-ids"), 24)
    further = F.lit(_FURTHER) + F.pmod(F.xxhash64("doc_id", body), F.lit(_FURTHER - 1))
    keyed = docs.join(twice, F.col("doc_id").cast("long") == F.col("_id"), "left").withColumn(
        "_key", F.when(F.col("_id").isNull() | (body == F.col("_first")), F.col("doc_id").cast("long")).otherwise(further)
    )
    groups = near_duplicates(keyed.select("_key", "text"), doc="_key")
    gone = scratch(groups.where(~F.col("kept")).select(F.col("_key").alias("_gone")), "near-duplicates").distinct()
    left = keyed.join(small_side(gone, 16), F.col("_key") == F.col("_gone"), "left_anti")
    once = left.where("_id is null").unionByName(left.where("_id is not null").dropDuplicates(["_key"]))
    return only(once, docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by its kind in angle brackets."""
    return _measured(masked(find_secrets(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of fixed length."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

# Language ID and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
