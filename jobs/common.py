"""What the jobs share: configuration, command line, logged reads and writes."""

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config_of(file: str, **changed) -> dict:
    """The config file of that name beside the jobs (or at a path), with settings replaced; an unknown setting is an error."""
    path = file if os.path.sep in file else os.path.join(os.path.dirname(os.path.abspath(__file__)), file)
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if unknown := sorted(set(changed) - set(config)):
        raise ValueError(f"unknown settings: {unknown}")
    return config | changed


def written(df: DataFrame, path: str, partitions, dynamic: bool = False) -> int:
    """Write a partitioned Parquet table over what was there; gives and logs its rows, counted on the way.

    ``dynamic``: only the partitions that the rows name are replaced.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*partitions).parquet(path)
    n = seen.get.get("rows", 0)  # a plan without rows may leave no count
    log.info("wrote %d rows to %s%s", n, path, " (only the partitions named)" if dynamic else "")
    return n


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of an earlier run with its partition columns as typed in ``schema``; empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def command_line(file: str, run: Callable[[SparkSession, dict], dict]) -> None:
    """``--config FILE --set name=value ...``: makes a session, runs the job, stops the session."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", default=file, help="JSON file of settings")
    parser.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="settings that replace those of the file; values are JSON or text")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    changed = {}
    for item in args.set:
        name, _, value = item.partition("=")
        try:
            changed[name] = json.loads(value)
        except json.JSONDecodeError:
            changed[name] = value
    spark = SparkSession.builder.appName(os.path.basename(file).split(".")[0]).getOrCreate()
    try:
        log.info("done: %s", run(spark, config_of(args.config, **changed)))
    finally:
        spark.stop()
