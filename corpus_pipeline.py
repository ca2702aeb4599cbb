"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` are applied in order, each written as Parquet and reread as the
next one's documents.  All but the last return the columns of documents.
"""

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import ngram, packing, ranking, rules, secrets
from tessella.llm.common import scratch, table

TOKENIZER = "byte_bpe_50k.json"
#: Near duplicates: words in a shingle, and the least similarity as a fraction.
WORDS, SIMILARITY = 5, (80, 100)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _learnable(doc_id):
    return ~ranking.held_out(doc_id)


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows beside their text, so that no column of theirs can clash with a statistic."""
    return docs.select(F.struct("*").alias("_row"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the pairwise ranking accepts."""
    ranker = ranking.train(docs, _labels(spark, sf_dir), _learnable)
    return ranking.score_documents(_rows(docs), ranker, "_row").where("predicted = 1").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that neither a base rule nor a learned rule rejects.

    The list is learned from the labelled rows of all documents of ``sf_dir``: what the classifier keeps has hardly a bad one left to learn from.
    """
    learned = rules.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), _labels(spark, sf_dir), _learnable)
    return rules.apply_rules(_rows(docs), learned, "_row").where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by near-duplicate texts: the least id (null last), then the least hash of the text.

    A row is named by its id and its text, so different texts that share an id
    are judged apart.  Of rows that repeat both, the least by a hash of all
    columns stays.  Rows without a word link with nothing and stay.
    """
    goes = F.col("first").isNotNull() & ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h")))
    found = ngram.linked_rows(docs, WORDS, *SIMILARITY).withColumn("goes", goes)
    per = found.groupBy("doc_id").agg(F.bool_and("goes").alias("all"), F.bool_or("goes").alias("some"))
    # an id whose texts all go is enough to name them; only where some stay the text is looked at too
    gone = table(per.where("all and doc_id is not null").select("doc_id"), "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = rows.join(gone, "doc_id", "left_anti").withColumnRenamed("doc_id", "_id")
    same = lambda names: F.col("_id").eqNullSafe(names["doc_id"]) & (F.col("_h") == names["h"])
    mixed = per.where("some and (not all or doc_id is null)").select(F.col("doc_id").alias("_mixed"))
    parted = table(found.where("goes").join(mixed, F.col("doc_id").eqNullSafe(F.col("_mixed")), "left_semi").select("doc_id", "h").distinct(), "gone-texts")
    if not parted.isEmpty():
        kept = kept.join(parted, same(parted), "left_anti")
    again = found.where("first is not null").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    if again.isEmpty():
        return kept.select("_row.*")
    order = Window.partitionBy("_id", "_h").orderBy(F.xxhash64("_row"))
    once = kept.join(again, same(again), "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return kept.join(again, same(again), "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts."""
    return secrets.redact_documents(docs, secrets.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    return packing.pack(docs, path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Trained stages and tokenization cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what they write in between is deleted at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as last:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return last(STAGES[-1][1](spark, docs, sf_dir), "packed")
