"""Grouped summaries with explicit denominators.  Each is one conditional aggregate: one shuffle on its keys."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, complete_mean, complete_sum, flag, percent, ratio, stratum
from .distribution import selected

CLASSES = ("A", "B")


def unique_keys(dim: DataFrame, *keys: str) -> DataFrame:
    """``dim``, after checking that ``keys`` name its rows: a join to it cannot multiply rows."""
    if not dim.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {keys}")
    return dim


def other_flag():
    """The marker of the other class."""
    return F.when(F.col("object_type") == CLASSES[0], F.col("b_present")).otherwise(F.col("a_present"))


def zero_box():
    return (F.col("xmin") == F.col("xmax")) | (F.col("ymin") == F.col("ymax"))


def any_diameter(test):
    """Whether one of the three diameters passes a test."""
    return test(F.col("min_diameter")) | test(F.col("median_diameter")) | test(F.col("max_diameter"))


#: Exact quantiles of a summary: name -> (column, probability).
QUANTILES = {
    "median_overlap_pct": ("overlap_pct", 0.5), "area_q25": ("area", 0.25), "area_median": ("area", 0.5), "area_q75": ("area", 0.75), "area_p99": ("area", 0.99),
    "median_intensity": ("intensity", 0.5), "p99_intensity": ("intensity", 0.99), "median_of_median_diameter": ("median_diameter", 0.5),
}


def object_summary(objects: DataFrame, keys=("job", "object_type")) -> DataFrame:
    """Counts, shares, sums and exact quantiles per group, with the share of the largest 1 %, in two readings of the table."""
    n, zero = F.count("*"), any_diameter(lambda d: d == 0)
    base = (
        n.alias("n_objects"),
        *(x for c in ("a", "b") for x in (F.count_if(f"{c}_present").alias(f"{c}_count"), percent(F.count_if(f"{c}_present"), n).alias(f"{c}_pct"))),
        F.count_if("other").alias("other_count"),
        percent(F.count_if("other"), n).alias("other_pct"),
        F.count_if(F.col("overlap_area") > 0).alias("overlap_count"),
        F.sum("area").alias("area_sum"),
        F.sum("overlap_area").alias("overlap_sum"),
        percent(F.sum("overlap_area"), F.sum("area")).alias("weighted_overlap_pct"),
        F.avg("overlap_pct").alias("mean_overlap_pct"),
        F.max("area").alias("max_area"),
        F.max("intensity").alias("max_intensity"),
        *(F.count_if(F.col(f"{c}_diameter") == 0).alias(f"zero_{c}_count") for c in ("min", "median", "max")),
        F.count_if(zero).alias("any_zero_count"),
        percent(F.count_if(zero), n).alias("any_zero_pct"),
        F.count_if(zero_box()).alias("zero_box_count"),
        percent(F.count_if(zero_box()), n).alias("zero_box_pct"),
    )
    return selected(objects.withColumn("other", other_flag()), QUANTILES, {"top_share_pct": ("area", 0.01)}, keys, base)


def distinct_ids(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """``(key, n_ids)``: known ids of each group.  An aggregate of its own: beside others, every row's share of those would move with its id."""
    return rows.groupBy(key, id_column).agg(F.count("*").alias("_n")).groupBy(key).agg(F.count(id_column).alias("n_ids"))


def quality_control(objects: DataFrame, key: str = "job", id_column: str = "object_id", extra=()) -> DataFrame:
    """Counters of odd rows, and any other aggregates; no row is removed."""
    error = F.abs(F.col("overlap_pct") - percent("overlap_area", "area"))
    odd = lambda e: F.count_if(F.coalesce(e, F.lit(True)))
    unknown = lambda c: F.col(c).isNull() | F.isnan(c) if dict(objects.dtypes)[c] in ("double", "float") else F.col(c).isNull()
    lo, mid, hi = (F.col(f"{c}_diameter") for c in ("min", "median", "max"))
    own = F.when(F.col("object_type") == CLASSES[0], F.col("a_present")).otherwise(F.col("b_present"))
    counters = objects.groupBy(key).agg(
        F.count("*").alias("n_objects"),
        sum((F.count_if(unknown(c)) for c in objects.columns), F.lit(0)).alias("missing_values"),
        F.count_if(F.col("area") <= 0).alias("nonpositive_area"),
        F.count_if(F.col("overlap_area") < 0).alias("negative_overlap"),
        F.count_if(F.col("overlap_area") > F.col("area") + 1e-6).alias("overlap_exceeds_area"),
        odd((F.col("overlap_pct") < 0) | (F.col("overlap_pct") > 100)).alias("pct_outside"),
        odd(~(error <= 0.001)).alias("formula_mismatch"),
        F.max(error).alias("max_formula_error"),
        F.count_if((F.col("overlap_area") > 0) != (F.col("a_present") & F.col("b_present"))).alias("presence_mismatch"),
        F.count_if(~own).alias("own_marker_absent"),
        F.count_if(any_diameter(lambda d: d == 0)).alias("any_zero_diameter"),
        F.count_if(any_diameter(lambda d: d < 0)).alias("any_negative_diameter"),
        F.count_if((lo > mid) | (mid > hi)).alias("diameter_order_mismatch"),
        F.count_if(zero_box()).alias("zero_box"),
        F.count_if((F.col("xmin") > F.col("xmax")) | (F.col("ymin") > F.col("ymax"))).alias("reversed_box"),
        F.count_if(F.col("inner_area") != 0).alias("nonzero_inner_area"),
        F.count_if(F.abs(F.col("inner_area") + F.col("outer_area") - F.col("area")) > 0.001).alias("area_partition_mismatch"),
        *extra,
    )
    ids = distinct_ids(objects, key, id_column).withColumnRenamed(key, "_of")
    both = counters.join(ids, F.col(key).eqNullSafe(F.col("_of")))
    rest = [c for c in counters.columns if c not in (key, "n_objects")]
    return both.select(key, "n_objects", (F.col("n_objects") - F.col("n_ids")).alias("duplicate_ids"), *rest)


def run_columns() -> tuple:
    """The aggregates of :func:`run_summary`."""
    a = F.col("object_type") == CLASSES[0]
    return (
        F.count_if(a).alias("n_a"),
        F.count_if(~a).alias("n_b"),
        percent(F.count_if(a & F.col("b_present")), F.count_if(a)).alias("association_pct"),
        *(f(c).alias(f"{c}_{f.__name__}") for c in ("x", "y") for f in (F.min, F.max)),
    )


def run_summary(objects: DataFrame, key: str = "job") -> DataFrame:
    """One row per export: class counts, association of class A, and extents over all rows."""
    return objects.groupBy(key).agg(*run_columns())


def type_weighting(objects: DataFrame, key: str = "job") -> DataFrame:
    """Per class: the mean of the exports' percentages beside the pooled one."""
    per = objects.groupBy(key, "object_type").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    return per.groupBy("object_type").agg(F.count("*").alias("n_exports"), F.avg(percent("k", "n")).alias("equal_mean_pct"), percent(F.sum("k"), F.sum("n")).alias("pooled_pct"))


def hierarchical_means(sections: DataFrame, metric: str, levels=("arm", "grp", "animal")) -> DataFrame:
    """Section -> replicate -> group: each level is the mean of the one below."""
    mid = sections.groupBy(*levels).agg(F.avg(metric).alias("m"), F.count("*").alias("k"))
    return mid.groupBy(*levels[:-1]).agg(F.count("*").alias("n_replicates"), F.sum("k").alias("n_sections"), F.avg("m").alias("mean_pct"))


def animal_summary(objects: DataFrame, keys=("arm", "grp", "animal")) -> DataFrame:
    """Replicate rows with area totals of class A by marker, and the count of class B."""
    a = F.col("object_type") == CLASSES[0]
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("area"))), F.lit(0.0))
    return objects.groupBy(*keys).agg(
        F.count_if(a).alias("n_a"),
        F.count_if(~a).alias("n_b"),
        F.count_if(a & F.col("b_present")).alias("k_a"),
        percent(F.count_if(a & F.col("b_present")), F.count_if(a)).alias("association_pct"),
        total(a).alias("area_a"),
        total(a & F.col("b_present")).alias("positive_area"),
        total(a & ~F.col("b_present")).alias("negative_area"),
        percent(total(a & F.col("b_present")), total(a)).alias("area_positive_pct"),
    )


def size_strata(objects: DataFrame, edges, keys=("job",)) -> DataFrame:
    """Rows of class A by size stratum; every stratum of every group is kept, rates of empty ones unknown."""
    spark = objects.sparkSession
    a = objects.where(F.col("object_type") == CLASSES[0])
    counts = a.groupBy(*keys, stratum("area", edges).alias("stratum")).agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    spine = objects.select(*keys).distinct().crossJoin(F.broadcast(spark.range(len(edges)).select(F.col("id").cast("int").alias("stratum"))))
    out = spine.join(counts, [*keys, "stratum"], "left").na.fill(0, ["n", "k"])
    return out.withColumn("rate_pct", percent("k", "n")).withColumn("share_pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def area_sensitivity(objects: DataFrame, thresholds, keys=("job",)) -> DataFrame:
    """Association of class A among objects of at least each area; thresholds that keep nothing stay, with an unknown rate."""
    a = objects.where(F.col("object_type") == CLASSES[0])
    aggregates = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("area") >= t).alias(f"n{i}"), F.count_if((F.col("area") >= t) & F.col("b_present")).alias(f"k{i}"))]
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("kept"), F.col(f"k{i}").alias("positive")) for i, t in enumerate(thresholds)))).alias("r")
    return a.groupBy(*keys).agg(*aggregates).select(*keys, rows).select(*keys, "r.*").withColumn("rate_pct", percent("positive", "kept"))


def overview(objects: DataFrame, key: str = "job") -> DataFrame:
    """Three denominators side by side: objects of A, objects of B, and area of A."""
    a = F.col("object_type") == CLASSES[0]
    return objects.groupBy(key).agg(
        percent(F.count_if(a & F.col("b_present")), F.count_if(a)).alias("a_with_b_pct"),
        percent(F.count_if(~a & F.col("a_present")), F.count_if(~a)).alias("b_with_a_pct"),
        percent(F.sum(F.when(a, F.col("overlap_area"))), F.sum(F.when(a, F.col("area")))).alias("area_overlap_pct"),
    )


def overlap_states(objects: DataFrame, keys=("job", "object_type")) -> DataFrame:
    v, n = F.col("overlap_pct"), F.count("*")
    states = {"zero": v == 0, "partial": (v > 0) & (v < 100), "full": v == 100}
    return objects.groupBy(*keys).agg(n.alias("n"), *(F.count_if(c).alias(f"{s}_n") for s, c in states.items()), *(percent(F.count_if(c), n).alias(f"{s}_pct") for s, c in states.items()))


def feature_prevalence(objects: DataFrame, features: dict, keys=("job", "object_type")) -> DataFrame:
    """Long form: one row per group and named condition."""
    wide = objects.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f) for f, c in features.items()))
    return wide.unpivot([*keys, "n"], list(features), "feature", "k").withColumn("pct", percent("k", "n"))


def section_counts(objects: DataFrame, keys=("arm", "grp")) -> DataFrame:
    """Sections by design cell, pivoted by group."""
    return objects.select("job", *keys).distinct().groupBy(keys[0]).pivot(keys[1], ["control", "treated"]).count()


def design_counts(metadata: DataFrame, keys=("image", "arm", "grp"), section: str = "job") -> DataFrame:
    """Sections of each design cell; ``metadata`` may repeat a section."""
    return metadata.groupBy(*keys).agg(F.countDistinct(section).alias("n_sections"))


def stratum_means(strata: DataFrame, keys=("arm",), groups=("control", "treated"), layer: str = "stratum") -> DataFrame:
    """Mean association of each size stratum and group, replicates weighing equally, groups side by side with their difference.

    ``strata``: a row per replicate and stratum with ``n`` and ``k``.  A
    replicate without rows in a stratum has no rate there and takes no part; the
    counts say how many did.
    """
    rate = F.when(F.col("n") > 0, percent("k", "n"))
    side = lambda f, g: f(F.when(F.col("grp") == g, rate))
    out = strata.groupBy(*keys, layer).agg(*(x for g in groups for x in (side(F.avg, g).alias(f"{g}_mean"), side(F.count, g).alias(f"{g}_n"))))
    return out.withColumn("difference", F.col(f"{groups[0]}_mean") - F.col(f"{groups[1]}_mean"))


def replicate_metrics(objects: DataFrame, keys=("arm", "grp", "animal")) -> DataFrame:
    """Seven metrics of class A per replicate; one unknown measurement makes its metric unknown."""
    a = F.col("object_type") == CLASSES[0]
    rows = objects.where(a)
    area, overlap, f = complete_sum("area"), complete_sum("overlap_area"), flag("b_present")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("b_present").isNull()).alias("missing_flags"),
        F.count_if(F.col("area").isNull()).alias("missing_areas"),
        (100 * complete_mean(f)).alias("association_pct"),
        complete_sum(f).alias("positive_count"),
        area.alias("area_sum"),
        complete_mean("area").alias("mean_area"),
        overlap.alias("overlap_sum"),
        percent(overlap, area).alias("area_overlap_pct"),
        ratio(overlap, F.count("*")).alias("overlap_per_object"),
    )


def pct_of_total(rows: DataFrame, value: str, keys) -> DataFrame:
    return rows.withColumn("pct_of_total", percent(col(value), F.sum(value).over(Window.partitionBy(*keys))))
