"""From raw documents to packed training sequences, each stage one operator of loomwright.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Edge cases, in every stage: columns other than those of documents are dropped, whatever their names; an
empty table gives an empty result; texts are taken whole, however long. What each stage does with null
columns and repeated rows is said below.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import jaccard_join, language_id, mixing, packing, pii
from loomwright.llm.common import PATHS, materialize, new_path, remove, small
from loomwright.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Languages, learned models and vocabularies make these stages inexpressible in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (`und`) go; a missing lang is filled in by the prediction.

    Null and empty texts and those without a letter go; rows without doc_id or source stay; repeated rows are told alike.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(~language_id.held_out()))
    told = language_id.predict(docs, model, extra=("lang", "source", "n_chars"), with_text=True)
    kept = told.where(F.col("lang_pred") != language_id.UND)
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def _hashes(text: str = "text") -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(k), F.col(text)).alias(f"_h{k}") for k in (1, 2)]


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, one without id behind all others.

    Every row is a document: repeated rows, and rows that share an id but not their text, are judged by their
    texts alone. Rows without a word link with nothing and stay.
    """
    # what has no id comes behind all ids, by a hash of its text
    place = F.coalesce(F.col("doc_id"), F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    rows = docs.select(*COLUMNS, place.alias("_id"), *_hashes())
    key = ["_id", "_h1", "_h2"]
    marked = jaccard_join.near_texts(rows, id_col="_id", marks=("_h1", "_h2")).withColumnRenamed("id", "_id")
    marked = materialize(marked, "classes")
    first = marked.groupBy("class_id").agg(F.min(F.struct(*key)).alias("x"))
    stays = first.select(*(F.col(f"x.{c}").alias(c) for c in key))
    gone = materialize(marked.select(*key).join(stays, key, "left_anti"), "gone")
    # a row that stays and is repeated leaves one of its rows
    again = rows.where(F.col("text").rlike(r"\S")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    again = materialize(again.join(gone, key, "left_anti"), "again")
    once = rows.join(small(gone), key, "left_anti")
    if again.isEmpty():
        return once.select(*COLUMNS)
    several = rows.join(small(again), key, "left_semi").groupBy(*key).agg(F.first(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return once.join(small(again), key, "left_anti").select(*COLUMNS).union(several)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; all documents stay.

    A null text stays null, with its n_chars; repeated rows are read alike.
    """
    docs = docs.select(*COLUMNS)
    clean = pii.find(docs, pii.learn(docs), redacting=True, extra=("lang", "source", "n_chars"))
    text = F.col("redacted")
    return clean.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy of a document that is taken in part is cut after its words.

    The rows come by shard, one partition (so one written file) each, in the shard's shuffled order. Null and
    blank texts are never taken; documents without source form one; repeated rows are documents of their own.
    """
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").alias("id"), *_hashes()).alias("_key"))
    taken = mixing.copies(mixing.mix(rows, key_col="_key"), mixing.SHARDS)
    # one row stands for all that are equal in id and text; their copies are joined to it
    each = rows.dropDuplicates(["_key"]).join(taken.select(F.col("key").alias("_key"), "words", "shard", "place"), "_key")
    size = mixing.word_count(F.col("text"))
    each = each.withColumn("size", size)
    cut = F.col("words") < F.col("size")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORD), F.lit(0))
    each = each.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("text")))
    each = each.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return each.repartitionById(mixing.SHARDS, F.col("shard")).sortWithinPartitions("shard", "place").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, vocabulary())


#: Tables that stages wrote on their way to a result which has been written since.
_left: list[str] = []


def _tidy(stage):
    """The stage, which first deletes what earlier ones left behind and its input does not read."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = remove(spark, _left, unless_read_by=docs)
        before = len(PATHS)
        out = stage(spark, docs, sf_dir)
        _left.extend(PATHS[before:])
        return out

    return run_stage


STAGES = [(name, _tidy(f)) for name, f in (("language_id", language), ("ngram_jaccard_join", near_copies), ("pii", personal_data), ("mixing", mixture), ("packing", packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
