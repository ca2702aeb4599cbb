"""Replicate-level contrasts.  Replicates weigh equally; objects are never pooled, except where a column says so.

All inputs have one row per arm and replicate (a dozen rows), already reduced
by one aggregate over the objects.
"""

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complete_mean, percent

CONTROL, TREATED = "control", "treated"
#: Replicates whose allocations are enumerated (12,870 of 16), and whose allocations are counted by halves (2 ** 20 sums each).
MAX_ALLOCATED, MAX_HALVED = 16, 40


def long_metrics(rows: DataFrame, metrics, keys=("arm", "grp", "animal")) -> DataFrame:
    """One row per replicate and metric."""
    return rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", "value")


def _side(group: str):
    return F.col("grp") == group


def contrast(long: DataFrame, keys=("arm", "metric")) -> DataFrame:
    """Control mean minus treated mean, complete means only, with counts of known values."""
    per = long.groupBy(*keys, "grp").agg(complete_mean("value").alias("mean"), F.count("value").alias("n_finite"))
    pick = lambda c, g: F.max(F.when(_side(g), F.col(c)))
    out = per.groupBy(*keys).agg(pick("mean", CONTROL).alias("control_mean"), pick("mean", TREATED).alias("treated_mean"), pick("n_finite", CONTROL).alias("control_n"), pick("n_finite", TREATED).alias("treated_n"))
    return out.withColumn("difference", F.col("control_mean") - F.col("treated_mean"))


def strict_contrast(long: DataFrame, per_group: int = 3, keys=("arm", "metric")) -> DataFrame:
    """Treated mean minus control mean with its leave-pair-out range; an error unless every group has ``per_group`` known replicates, each once."""
    faults = long.groupBy(*keys).agg(
        *(F.count_if(_side(g)).alias(f"n_{g}") for g in (CONTROL, TREATED)),
        F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("unknown"),
        (F.count("*") - F.countDistinct("grp", "animal")).alias("repeated"),
    )
    bad = faults.where((F.col(f"n_{CONTROL}") != per_group) | (F.col(f"n_{TREATED}") != per_group) | (F.col("unknown") > 0) | (F.col("repeated") > 0)).limit(10).collect()
    if bad:
        raise ValueError(f"{per_group} known replicates a group are needed: {[tuple(r) for r in bad]}")
    both = contrast(long, keys).join(leave_pair_out(long, keys), list(keys))
    return both.select(*keys, "control_mean", "treated_mean", (-F.col("difference")).alias("difference"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))


def cluster_contrasts(composition: DataFrame, keys=("arm", "cluster")) -> DataFrame:
    """Contrasts of each cluster's share and association, replicates weighing equally (``composition``: one row per replicate and cluster)."""
    return contrast(long_metrics(composition, ("share_pct", "rate_pct"), (*keys, "grp", "animal")), (*keys, "metric"))


def leave_pair_out(long: DataFrame, keys=("arm", "metric")) -> DataFrame:
    """The difference after leaving out one replicate of each group, all combinations; the least and the greatest."""
    w = Window.partitionBy(*keys, "grp")
    rest = long.select(*keys, "grp", "animal", F.when(F.count("value").over(w) == F.count("*").over(w), (F.sum("value").over(w) - F.col("value")) / (F.count("*").over(w) - 1)).alias("m"))
    a, b = rest.where(_side(CONTROL)), rest.where(_side(TREATED)).withColumnRenamed("m", "t").withColumnRenamed("animal", "other")
    pairs = a.join(b.drop("grp"), list(keys)).withColumn("d", F.col("m") - F.col("t"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.min("d").alias("low"), F.max("d").alias("high"))


def cross_replicate(long: DataFrame, keys=("arm", "metric")) -> DataFrame:
    """Every control replicate against every treated one."""
    a = long.where(_side(CONTROL)).select(*keys, F.col("animal").alias("control_id"), F.col("value").alias("c"))
    b = long.where(_side(TREATED)).select(*keys, F.col("animal").alias("treated_id"), F.col("value").alias("t"))
    return a.join(b, list(keys)).select(*keys, "control_id", "treated_id", (F.col("c") - F.col("t")).alias("difference"))


def exact_allocation(long: DataFrame, keys=("arm", "metric")) -> DataFrame:
    """All ways to call as many replicates control as there are; two-sided exact p of the observed difference.

    ``p`` is the share of allocations whose absolute difference is at least the
    observed one (1e-12 slack); unknown if any value is.  Up to MAX_ALLOCATED
    replicates all allocations are rows; up to MAX_HALVED they are counted by
    :func:`tail_counts`; more are an error.
    """
    most = long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_HALVED:
        raise ValueError(f"{most} replicates: more than {MAX_HALVED}")
    if most > MAX_ALLOCATED:
        return _allocation_by_halves(long, list(keys))
    w = Window.partitionBy(*keys)
    numbered = long.withColumn("i", F.row_number().over(w.orderBy("animal")) - 1)
    packed = numbered.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("i", "value", (F.col("grp") == CONTROL).alias("c")))).alias("r"), F.count_if(_side(CONTROL)).alias("k"), F.count("*").alias("n"), F.count("value").alias("known")
    )
    sizes = [(r["n"], r["k"]) for r in packed.select("n", "k").distinct().collect()]  # at most MAX_ALLOCATED squared
    chosen = long.sparkSession.createDataFrame([(n, k, a, list(c)) for n, k in sizes for a, c in enumerate(combinations(range(n), k))] or [(0, 0, 0, [])], "n long, k long, allocation int, chosen array<int>")
    rows = packed.join(F.broadcast(chosen), ["n", "k"])
    total = F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x["value"])
    inside = F.aggregate(F.filter("r", lambda x: F.array_contains("chosen", x["i"])), F.lit(0.0), lambda acc, x: acc + x["value"])
    observed = F.forall("r", lambda x: x["c"] == F.array_contains("chosen", x["i"]))
    rows = rows.select(*keys, "allocation", observed.alias("observed"), F.when(F.col("known") == F.col("n"), inside / F.col("k") - (total - inside) / (F.col("n") - F.col("k"))).alias("difference"))
    seen = F.max(F.when(F.col("observed"), F.col("difference"))).over(w)
    rows = rows.withColumn("extreme", F.abs("difference") >= F.abs(seen) - 1e-12)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_allocations"), F.max(F.when(F.col("observed"), F.col("difference"))).alias("observed_difference"), F.when(F.count("difference") == F.count("*"), F.avg(F.col("extreme").cast("int"))).alias("p"))


def tail_counts(values, k: int, low: float, high: float) -> tuple:
    """How many of all ``k``-subsets of the values there are, and how many have a sum of ``low`` at most or ``high`` at least.

    The values are cut in two halves: the subset sums of both, by size and
    sorted, meet in a search, so n values take about 2 ** (n / 2) steps.
    """
    values = np.asarray(values, float)
    halves = []
    for part in (values[: len(values) // 2], values[len(values) // 2 :]):
        sums, sizes = np.zeros(1), np.zeros(1, np.int64)
        for v in part:
            sums, sizes = np.concatenate([sums, sums + v]), np.concatenate([sizes, sizes + 1])
        halves.append({j: np.sort(sums[sizes == j]) for j in range(len(part) + 1)})
    total = tail = 0
    for j, mine in halves[0].items():
        other = halves[1].get(k - j)
        if other is None:
            continue
        total += len(mine) * len(other)
        below = np.searchsorted(other, low - mine, side="right")
        above = len(other) - np.searchsorted(other, high - mine, side="left")
        both = np.maximum(below + above - len(other), 0)  # where the two tails meet
        tail += int((below + above - both).sum())
    return total, tail


def _allocation_by_halves(long: DataFrame, keys: list) -> DataFrame:
    """:func:`exact_allocation` of up to MAX_HALVED replicates; a group of them is one task's."""

    def run(key, pdf):
        values, mine = pdf["value"].to_numpy(float), (pdf["grp"] == CONTROL).to_numpy()
        n, k = len(values), int(mine.sum())
        total = math.comb(n, k)
        if np.isnan(values).any() or k in (0, n):
            row = (*key, total, None, None)
        else:
            d = values[mine].mean() - values[~mine].mean()
            # a subset's difference is its sum times ``unit``, less ``rest``
            unit, rest = 1 / k + 1 / (n - k), values.sum() / (n - k)
            reach = abs(d) - 1e-12
            row = (*key, total, d, 1.0 if reach <= 0 else tail_counts(values, k, (rest - reach) / unit, (rest + reach) / unit)[1] / total)
        return pd.DataFrame([row], columns=[*keys, "n_allocations", "observed_difference", "p"])

    kinds = dict(long.dtypes)
    return long.select(*keys, "grp", "value").groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_allocations long, observed_difference double, p double"]))


def standardized(strata: DataFrame, minimum: int = 10, replicates: int = 6, keys=("arm",), layer: str = "stratum") -> DataFrame:
    """Raw, restricted and directly standardised differences.

    ``strata``: one row per arm, replicate and stratum with ``n`` and ``k``
    (and ``grp``).  A stratum is eligible if every replicate has at least
    ``minimum`` rows in it; it is dropped for all if not.  Common weights are
    the replicates' mean shares over eligible strata, made to sum to 1.
    """
    at = Window.partitionBy(*keys, layer)
    marked = strata.withColumn("eligible", (F.min("n").over(at) >= minimum) & (F.count("*").over(at) == replicates))
    per = Window.partitionBy(*keys, "animal")
    inside = F.sum(F.when(F.col("eligible"), F.col("n"))).over(per)
    marked = marked.withColumn("share", F.when(F.col("eligible"), F.col("n") / F.nullif(inside, F.lit(0))))
    marked = marked.withColumn("w", F.avg("share").over(at))
    rate, ok = F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.col("eligible")
    rows = marked.groupBy(*keys, "grp", "animal").agg(
        percent(F.sum("k"), F.sum("n")).alias("raw"),
        percent(F.sum(F.when(ok, F.col("k"))), F.sum(F.when(ok, F.col("n")))).alias("restricted"),
        (100 * F.sum(F.when(ok, F.col("w") * rate))).alias("standardized"),
        percent(F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)), F.sum("n")).alias("retained_pct"),
    )
    return rows


def standardized_contrast(strata: DataFrame, minimum: int = 10, **more) -> DataFrame:
    rows = standardized(strata, minimum, **more)
    return contrast(long_metrics(rows, ("raw", "restricted", "standardized", "retained_pct")))


def support(strata: DataFrame, minimum: int = 10, replicates: int = 6, keys=("arm",), layer: str = "stratum") -> DataFrame:
    """Which strata are eligible, and why not."""
    out = strata.groupBy(*keys, layer).agg(F.min("n").alias("least_n"), F.count("*").alias("present"), F.count_if(F.col("n") < minimum).alias("below"))
    why = F.concat_ws(", ", F.when(F.col("present") < replicates, F.lit("replicate missing")), F.when(F.col("below") > 0, F.lit("fewer than the minimum")))
    return out.withColumn("eligible", (F.col("present") == replicates) & (F.col("below") == 0)).withColumn("reason", why)


def normalization_audit(rows: DataFrame, least: int = 3) -> DataFrame:
    """Four estimands side by side, control minus treated, the pooled one as a diagnostic.

    ``rows``: ``arm, grp, animal, n, k, standardized, area_overlap_pct``, a row
    per replicate; ``standardized`` is its rate under the common size mix (of
    :func:`standardized`).  Replicates weigh equally and must all be known; the
    pooled rate weighs objects and needs ``least`` known counts in each group.
    """
    side = lambda g, c: F.when(_side(g), c)
    pooled = lambda g: F.when(F.count(side(g, F.col("k"))) >= least, percent(F.sum(side(g, F.col("k"))), F.sum(side(g, F.col("n")))))
    mean = lambda g, c: F.when((F.count_if(_side(g)) > 0) & (F.count_if(_side(g)) == F.count(side(g, F.col(c)))), F.avg(side(g, F.col(c))))
    equal = lambda c: mean(CONTROL, c) - mean(TREATED, c)
    return rows.withColumn("rate", percent("k", "n")).groupBy("arm").agg(
        equal("rate").alias("equal_rate"), equal("standardized").alias("equal_standardized"), equal("area_overlap_pct").alias("equal_area_overlap"), (pooled(CONTROL) - pooled(TREATED)).alias("pooled_rate")
    )


def directions(long: DataFrame, keys=("arm", "metric")) -> DataFrame:
    """Each contrast in both directions: difference, relative change, ratio, standard error, difference per error, and its leave-pair-out range."""
    per = long.groupBy(*keys, "grp").agg(complete_mean("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
    a = per.where(_side(CONTROL)).select(*keys, F.col("m").alias("a"), (F.col("v") / F.col("n")).alias("ea"))
    b = per.where(_side(TREATED)).select(*keys, F.col("m").alias("b"), (F.col("v") / F.col("n")).alias("eb"))
    both = a.join(b, list(keys)).join(leave_pair_out(long, keys), list(keys), "left").withColumn("se", F.sqrt(F.col("ea") + F.col("eb")))

    def one(name, x, y, low, high):
        d = F.col(x) - F.col(y)
        return F.struct(F.lit(name).alias("direction"), d.alias("difference"), percent(d, F.col(y)).alias("relative_pct"), F.when(F.col(y) > 0, F.col(x) / F.col(y)).alias("ratio"), F.col("se").alias("se"), F.when(F.col("se") > 0, d / F.col("se")).alias("per_se"), low.alias("low"), high.alias("high"))

    ways = F.array(one("control - treated", "a", "b", F.col("low"), F.col("high")), one("treated - control", "b", "a", -F.col("high"), -F.col("low")))
    return both.select(*keys, F.inline(ways))


def paired_arms(rows: DataFrame, metric: str, arms=("arm1", "arm2")) -> DataFrame:
    """Within a replicate: both arms and the second minus the first."""
    wide = rows.groupBy("animal", "grp").pivot("arm", list(arms)).agg(F.first(metric))
    return wide.withColumn("gap", F.col(arms[1]) - F.col(arms[0]))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(pair("n").alias("i"), F.sum("n").alias("t"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pair("n").alias("ra"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pair("n").alias("rb"))
    expected = F.col("ra") * F.col("rb") / F.nullif(F.col("t") * (F.col("t") - 1) / 2, F.lit(0.0))
    top = (F.col("ra") + F.col("rb")) / 2
    return both.crossJoin(ra).crossJoin(rb).select(F.when(F.coalesce(top == expected, F.lit(True)), 1.0).otherwise((F.col("i") - expected) / F.nullif(top - expected, F.lit(0.0))).alias("ari"))
