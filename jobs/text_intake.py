"""Intake of text exports: what is new is measured and checked, and the reports of its languages are brought up to date.

Exports arrive as files with ``doc_id, text, lang, source, n_chars``.  As with
measurement exports, no row is dropped: what is odd about it is named.

* ``rows/`` (by ``batch`` and ``lang``): one row per document with its sizes,
  the digest of its text and its faults.  Every micro-batch overwrites the
  partitions of its own number, so a batch that is run again replaces itself.
* ``sections/`` (by ``lang``): per source of a language the counters of faults,
  totals, shares, size strata, exact quantiles, the share of the longest
  hundredth, and how many texts repeat.  Only languages with rows newer than
  their report are read and rewritten; ``through_batch`` is their mark.

The stream's checkpoint knows which files were taken: a second run takes only
files that have come since.  A run that is cut short is made good by the next
one: the stream runs its last batch again, and reports older than their rows
are written.  A file that is changed in place is not read again.

Nulls: an unknown language or source (null or empty) is ``und``; an unknown
text has no digest and no size.  Extra columns are not read.

    python -m jobs.text_intake --set input=s3a://in/documents output=... checkpoint=...
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import percent, reasons, stratum
from tessella.operators.distribution import selected

from .common import command_line, log, stored, written

CONFIG = "text_intake.json"
WORD = r"[^\x20\x09-\x0D]+"
ROWS = "doc_id long, source string, text_sha256 string, n_bytes long, n_chars long, n_words long, n_lines long, stated_chars long, stratum int, faults string, batch long, lang string"
#: Columns that an export must have; others are not read.
NEEDED = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FAULTS = ("no_id", "no_text", "empty_text", "no_language", "no_source", "length_differs", "few_words")


def measured(docs: DataFrame, edges, short_words: int) -> DataFrame:
    """One row per document: sizes, digest, stratum of its words, and its faults in a fixed order."""
    text, blank = F.col("text"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    sized = docs.select(
        "doc_id",
        F.when(blank("source"), F.lit("und")).otherwise(F.col("source")).alias("source"),
        F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.length("text").cast("long").alias("n_chars"),
        words.alias("n_words"),
        F.when(text == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.col("n_chars").alias("stated_chars"),
        F.when(blank("lang"), F.lit("und")).otherwise(F.col("lang")).alias("lang"),
        blank("lang").alias("_no_language"),
        blank("source").alias("_no_source"),
    )
    found = dict(
        no_id=F.col("doc_id").isNull(),
        no_text=F.col("n_chars").isNull(),
        empty_text=F.col("n_words") == 0,
        no_language=F.col("_no_language"),
        no_source=F.col("_no_source"),
        length_differs=~F.col("stated_chars").eqNullSafe(F.col("n_chars")),
        few_words=(F.col("n_words") > 0) & (F.col("n_words") < short_words),
    )
    return sized.withColumn("stratum", stratum("n_words", edges)).withColumn("faults", reasons(**found)).drop("_no_language", "_no_source")


def sections(rows: DataFrame, edges, quantiles) -> DataFrame:
    """The report of each (language, source) of ``rows``."""
    keys, named = ["lang", "source"], lambda f: F.col("faults").contains(f.replace("_", " "))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("faults") != "").alias("n_faulty"),
        *(F.count_if(named(f)).alias(f"n_{f}") for f in FAULTS),
        *map(total, ("n_bytes", "n_chars", "n_words")),
        *(F.count_if(F.col("stratum") == i).alias(f"n_stratum_{i}") for i in range(len(edges))),
        F.max("batch").alias("_last"),
    )
    texts = rows.where("text_sha256 is not null").groupBy(*keys, "text_sha256").agg(F.count("*").alias("n"))
    texts = texts.groupBy(*keys).agg(F.count("*").alias("n_texts"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("n_repeated"))
    exact = selected(rows, {f"words_p{round(100 * q):02d}": ("n_words", q) for q in quantiles}, {"top_share_pct": ("n_words", 0.01)}, keys)
    out = base.join(texts, keys, "left").join(exact, keys, "left")
    of_lang = rows.groupBy("lang").agg(F.sum("n_words").alias("_words"), F.max("batch").alias("through_batch"))
    out = out.join(of_lang, "lang").withColumn("words_pct", percent("n_words", "_words"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_texts", "n_repeated")}).drop("_last", "_words")


def section_schema(edges, quantiles) -> str:
    counts = ["n_documents", "n_faulty", *(f"n_{f}" for f in FAULTS), "n_bytes", "n_chars", "n_words", *(f"n_stratum_{i}" for i in range(len(edges))), "n_texts", "n_repeated"]
    numbers = [*(f"words_p{round(100 * q):02d}" for q in quantiles), "top_share_pct"]
    return ", ".join(["source string", *(f"{c} long" for c in counts), *(f"{c} double" for c in numbers), "through_batch long", "words_pct double", "lang string"])


def _any(path: str) -> str:
    """The path as a pattern that matches only itself: a file stream takes a single file, like a folder, only by a pattern."""
    return path if set(path) & set("*?[{") else re.sub(r"(\w)/*$", r"[\1]", path)


def run(spark: SparkSession, config: dict) -> dict:
    """Take the text exports that are new, and report on the languages they belong to."""
    edges, output = config["word_edges"], config["output"].rstrip("/")
    rows_at, sections_at, taken = f"{output}/rows", f"{output}/sections", []

    def batch(docs: DataFrame, number: int) -> None:
        rows = measured(docs, edges, config["short_words"]).withColumn("batch", F.lit(number).cast("long"))
        taken.append(written(rows, rows_at, ("batch", "lang"), dynamic=True))

    source = spark.readStream.format(config["format"]).schema(NEEDED)
    if config["format"] == "csv":
        source = source.option("header", True).option("multiLine", True)
    if config["files_per_batch"]:
        source = source.option("maxFilesPerTrigger", config["files_per_batch"])
    log.info("reading new files of %s", config["input"])
    stream = source.load(_any(config["input"])).writeStream.foreachBatch(batch).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("took %d rows in %d batches", sum(taken), len(taken))

    rows, have = stored(spark, rows_at, ROWS), stored(spark, sections_at, section_schema(edges, config["quantiles"]))
    # Languages are folders, so they can be named; both sides give one row each.
    newest = rows.groupBy("lang").agg(F.max("batch").alias("newest"))
    marks = have.groupBy("lang").agg(F.max("through_batch").alias("mark"))
    stale = newest.join(marks, "lang", "left").where("mark is null or mark < newest").select("lang")
    langs = [r["lang"] for r in stale.collect()]
    n = 0
    if langs:
        log.info("reports of %d languages are older than their rows", len(langs))
        n = written(sections(rows.where(F.col("lang").isin(*langs)), edges, config["quantiles"]), sections_at, ("lang",), dynamic=True)
    return {"rows_taken": sum(taken), "batches": len(taken), "languages": len(langs), "sections_written": n}


if __name__ == "__main__":
    command_line(CONFIG, run)
