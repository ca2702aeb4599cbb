"""Condition report: from measurement exports to the contrasts of a balanced study, in one call.

``fields`` of the config are the SQL expressions that make objects out of the
exports' columns.  The design is checked before anything is written; odd rows
are counted and never removed.

* ``quality/`` (by ``arm``): counters of odd rows per section, and its extents.
* ``sections/`` (by ``arm``): counts, shares, sums and exact quantiles per section and class.
* ``replicates/`` (by ``arm``): the metrics of each replicate, with its association raw, restricted to the size strata
  that all replicates share, and standardised to their common mix.
* ``contrasts/`` (by ``arm``): per metric the groups' means, their difference, its leave-pair-out range and the exact
  allocation p.

Every table is overwritten as a whole, so a run that is repeated leaves the
same.  Unknown values stay unknown; an empty table is a design fault.

    python -m jobs.condition_report --set input=... output=...
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import midpoint, stratum
from tessella.operators import contrast, summary
from tessella.operators.distribution import kept
from tessella.plans.design import Design

from .common import command_line, log, written

CONFIG = "condition_report.json"
TABLES = ("quality", "sections", "replicates", "contrasts")


def objects_of(spark: SparkSession, config: dict) -> DataFrame:
    """The exports as objects; only the columns that ``fields`` name are read."""
    rows = spark.read.format(config["format"]).load(config["input"]).select(*(F.expr(e).alias(name) for name, e in config["fields"].items()))
    return rows.withColumn("x", midpoint("xmin", "xmax")).withColumn("y", midpoint("ymin", "ymax"))


def tables(objects: DataFrame, metadata: DataFrame, config: dict) -> dict:
    """The report's tables.  ``metadata``: one row per section, checked to be few.

    The exports are read for sections, their quality and their replicates; the
    replicates' rows are kept, so contrasts read those and not the exports again.
    """
    arm_of = F.broadcast(metadata.select("job", "arm"))
    quality = summary.quality_control(objects.drop("arm", "grp", "animal"), extra=summary.run_columns()).join(arm_of, "job")
    metrics = summary.replicate_metrics(objects)
    strata = objects.where(F.col("object_type") == config["classes"][0])
    strata = strata.groupBy("arm", "grp", "animal", stratum("area", config["size_edges"]).alias("stratum")).agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    shares = contrast.standardized(strata, config["least_per_stratum"], 2 * config["per_group"])
    replicates = kept(metrics.join(shares, ["arm", "grp", "animal"]))
    long = contrast.long_metrics(replicates, (*config["metrics"], "restricted", "standardized"))
    keys = ["arm", "metric"]
    contrasts = contrast.contrast(long).join(contrast.leave_pair_out(long), keys).join(contrast.exact_allocation(long).drop("observed_difference"), keys)
    return {"quality": quality, "sections": summary.object_summary(objects, ("arm", "job", "object_type")), "replicates": replicates, "contrasts": contrasts}


def run(spark: SparkSession, config: dict) -> dict:
    """Check the exports against the design and write the report's tables."""
    design = Design(groups=tuple(config["groups"]), arms=tuple(config["arms"]), classes=tuple(config["classes"]), per_group=config["per_group"])
    objects = objects_of(spark, config)
    log.info("reading %s", config["input"])
    metadata = kept(objects.select("job", "animal", "grp", "arm").distinct())
    design.check_metadata(metadata)
    design.check_objects(objects, metadata)
    log.info("the design holds: %d arms, %d replicates a group", len(config["arms"]), config["per_group"])
    output = config["output"].rstrip("/")
    return {name: written(df, f"{output}/{name}", ("arm",)) for name, df in tables(objects, metadata, config).items()}


if __name__ == "__main__":
    command_line(CONFIG, run)
