"""Morphology clustering: balanced sample, robust scale, k-means, exact assignment, audits.

The fit sees only log area and shape: no group, flag or coordinate.  Samples
are the least rows by md5 of seed and id, so neither row order nor partitioning
changes a model; a sample has at most ``cap`` rows per replicate and is fitted
on the driver, while assignment is one expression over centroid literals.
"""

from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, reasons
from .distribution import _least, kept, nearest_to, quantile_columns

FEATURES = ("log_area", "shape")
#: Replicates of a design.
MAX_REPLICATES = 1_000


def valid_morphology():
    """Finite measurements, positive area and largest diameter, ``0 <= min <= max``; a zero minimum is valid."""
    a, lo, hi = (finite(c) for c in ("area", "min_diameter", "max_diameter"))
    return F.coalesce((a > 0) & (hi > 0) & (lo >= 0) & (lo <= hi), F.lit(False))


def exclusion_reasons():
    """Why a row is not valid, in this order; of an unknown diameter nothing more is said."""
    a, lo, hi = (finite(c) for c in ("area", "min_diameter", "max_diameter"))
    known, both_zero = lo.isNotNull() & hi.isNotNull(), (lo == 0) & (hi == 0)
    return reasons(
        unknown_area=a.isNull(), area_not_positive=a <= 0, unknown_diameter=~known, both_diameters_zero=known & both_zero,
        largest_diameter_not_positive=known & ~both_zero & (hi <= 0), negative_minimum=known & (lo < 0), minimum_above_maximum=known & (lo > hi),
    )


def prepare(objects: DataFrame) -> DataFrame:
    """Rows of class A with ``valid``, ``log_area``, ``shape`` and ``excluded`` (why not)."""
    a = objects.where("object_type = 'A'").withColumn("valid", valid_morphology())
    return a.withColumn("log_area", F.when(F.col("valid"), F.log10("area"))).withColumn("shape", F.when(F.col("valid"), F.col("min_diameter") / F.col("max_diameter"))).withColumn("excluded", F.when(~F.col("valid"), exclusion_reasons()))


def balanced_sample(valid: DataFrame, cap: int, seed: int, replicate: str = "animal", id_column: str = "object_id") -> DataFrame:
    """As many rows of each replicate: the least of ``cap`` and the smallest replicate, four at least."""
    least = valid.groupBy(replicate).count().agg(F.min("count")).first()[0] or 0
    take = min(cap, least)
    if take < 4:
        raise ValueError("a replicate has fewer than four valid rows")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(replicate).cast("string"), F.col(id_column).cast("string")))
    return valid.withColumn("_r", F.row_number().over(Window.partitionBy(replicate).orderBy(order, id_column))).where(F.col("_r") <= take).drop("_r")


@dataclass(frozen=True)
class Model:
    """Centroids in scaled space, ordered by their raw values."""

    features: tuple
    center: tuple
    scale: tuple
    centroids: tuple
    inertia: float
    seed: int

    def distances(self):
        """Squared distance to each centroid with its number; unknown where a feature is."""
        d = []
        for k, c in enumerate(self.centroids, 1):
            terms = [((F.col(f) - m) / s - v) * ((F.col(f) - m) / s - v) for f, m, s, v in zip(self.features, self.center, self.scale, c, strict=True)]
            d.append(F.struct(sum(terms[1:], terms[0]).alias("d"), F.lit(k).alias("k")))
        known = F.col(self.features[0]).isNotNull()
        for f in self.features[1:]:
            known = known & F.col(f).isNotNull()
        return F.when(known, F.array(*d))

    def assign(self):
        """Number (from 1) of the nearest centroid, the first of equals; unknown where a feature is."""
        return F.array_min(self.distances())["k"]


def scales(valid: DataFrame, keys=("arm",), features=FEATURES) -> DataFrame:
    """Exact centre and scale of each feature by group: median; interquartile range, or standard deviation, or 1."""
    keys = list(keys)
    wanted = {f"{f}_{n}": (f, q) for f in features for n, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))}
    spread = valid.groupBy(*keys).agg(*(F.stddev_pop(f).alias(f"{f}_sd") for f in features))
    both = quantile_columns(valid, wanted, keys).join(spread, keys)
    columns = []
    for f in features:
        range_, sd = F.col(f"{f}_hi") - F.col(f"{f}_lo"), F.col(f"{f}_sd")
        columns += [F.col(f"{f}_mid").alias(f"{f}_center"), F.when(range_ > 0, range_).when(sd > 0, sd).otherwise(1.0).alias(f"{f}_scale")]
    return both.select(*keys, *columns)


def robust_scale(x: np.ndarray) -> tuple:
    """Exact median; interquartile range, or standard deviation, or 1."""
    q = np.percentile(x, [25, 75], axis=0)
    scale = q[1] - q[0]
    scale = np.where(scale > 0, scale, x.std(axis=0))
    return np.median(x, axis=0), np.where(scale > 0, scale, 1.0)


def fit(sample: DataFrame, k: int, seed: int = 20, starts: int = 8, rounds: int = 60, features=FEATURES, order_by=("animal", "object_id")) -> Model:
    """The model of a sample, see :func:`fit_points`."""
    x = np.array([tuple(r) for r in sample.orderBy(*order_by).select(*features).collect()], dtype=float).reshape(-1, len(features))
    return fit_points(x, k, seed, starts, rounds, features)


def fit_points(x: np.ndarray, k: int, seed: int = 20, starts: int = 8, rounds: int = 60, features=FEATURES) -> Model:
    """Best of several k-means++ starts; a start that empties a cluster is rejected."""
    center, scale = robust_scale(x)
    z, best = (x - center) / scale, None
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        c = z[[rng.integers(len(z))]]
        for _ in range(k - 1):
            d = ((z[:, None] - c) ** 2).sum(-1).min(1)
            c = np.vstack([c, z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))]])
        for _ in range(rounds):
            lab = ((z[:, None] - c) ** 2).sum(-1).argmin(1)
            if len(np.unique(lab)) < k:
                break
            new = np.array([z[lab == j].mean(0) for j in range(k)])
            if np.allclose(new, c, rtol=0, atol=1e-12):
                break
            c = new
        d = ((z[:, None] - c) ** 2).sum(-1)
        if len(np.unique(d.argmin(1))) == k and np.isfinite(c).all() and (best is None or d.min(1).sum() < best[0]):
            best = (float(d.min(1).sum()), c)
    if best is None:
        raise ValueError("every start emptied a cluster")
    c = sorted(map(tuple, best[1].tolist()), key=lambda v: tuple(np.array(v) * scale + center))
    return Model(tuple(features), tuple(center.tolist()), tuple(scale.tolist()), tuple(c), best[0], seed)


def match_centroids(model: Model, other: Model) -> dict:
    """The one-to-one map of labels of ``other`` to ``model`` of least total squared distance, in the scale of ``model`` (all k! tried)."""
    center, scale = np.array(model.center), np.array(model.scale)
    raw = np.array(other.centroids) * np.array(other.scale) + np.array(other.center)
    cost = (((raw - center) / scale)[:, None] - np.array(model.centroids)) ** 2
    cost, k = cost.sum(-1), len(model.centroids)
    best = min(permutations(range(k)), key=lambda p: sum(cost[j, p[j]] for j in range(k)))
    return {j + 1: best[j] + 1 for j in range(k)}


def agreement(counts: np.ndarray) -> dict:
    """Adjusted Rand index, percent agreement and Jaccard by label of a square table of matched labels."""
    pairs = lambda n: (n * (n - 1) / 2).sum()
    n, a, b, both = counts.sum(), pairs(counts.sum(1)), pairs(counts.sum(0)), pairs(counts)
    expected = a * b / pairs(np.array([n])) if n > 1 else 0.0
    union = counts.sum(0) + counts.sum(1) - np.diag(counts)
    top = (a + b) / 2
    return {
        "ari": 1.0 if top == expected else float((both - expected) / (top - expected)),
        "agreement_pct": float(100 * np.trace(counts) / n) if n else None,
        "jaccard": {i + 1: float(counts[i, i] / u) if u else None for i, u in enumerate(union)},
    }


def leave_one_out(valid: DataFrame, model: Model, cap: int = 3000, replicate: str = "animal", **more) -> list:
    """Refits without each replicate, compared on the one left out, which is in neither sample nor scale.

    ``valid`` holds a design's replicates, MAX_REPLICATES at most; ``k * k``
    counts are fetched for each.
    """
    k, out = len(model.centroids), []
    names = [x[0] for x in valid.select(replicate).distinct().limit(MAX_REPLICATES + 1).collect()]
    if len(names) > MAX_REPLICATES:
        raise ValueError(f"more than {MAX_REPLICATES} replicates")
    for r in sorted(names):
        again = fit(balanced_sample(valid.where(F.col(replicate) != r), cap, model.seed, replicate), k, model.seed, features=model.features, **more)
        to, counts = match_centroids(model, again), np.zeros((k, k))
        for a, b, n in valid.where(F.col(replicate) == r).groupBy(model.assign().alias("a"), again.assign().alias("b")).count().collect():
            counts[a - 1, to[b] - 1] = n
        out.append({"left_out": r, "model": again, "map": to, "n": int(counts.sum()), **agreement(counts)})
    return out


def area_only(prepared: DataFrame) -> DataFrame:
    """Rows with a known positive area, whatever their diameters: for a model of ``features=("log_area",)``."""
    rows = prepared.where(finite("area") > 0)
    return rows.withColumn("log_area", F.log10("area"))


def centroid_distance(model: Model):
    """Squared distance to the nearest centroid in the model's scale; unknown where a feature is."""
    return F.array_min(model.distances())["d"]


def display_sample(rows: DataFrame, most: int = 500, seed: int = 20, key: str = "job", id_column: str = "object_id") -> DataFrame:
    """At most ``most`` rows of each section: the least by md5 of seed, section and id."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col(id_column).cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, id_column))).where(F.col("_r") <= most).drop("_r")


def review_targets(assigned: DataFrame, distance: str, keys=("job", "cluster"), id_column: str = "object_id") -> DataFrame:
    """Per section and cluster the row nearest to the least distance and the one nearest to the 99th percentile, ties by id."""
    keys = list(keys)
    rows = kept(assigned.select(*keys, id_column, distance)).where(F.col("cluster").isNotNull())  # the model is applied once, then its distances are read
    typical = _least(rows, F.col(distance), keys, id_column).select(*keys, F.lit("typical").alias("selection"), id_column, distance)
    far = nearest_to(rows, distance, 0.99, keys, id_column)
    return typical.unionByName(far.select(*keys, F.lit("99th percentile").alias("selection"), id_column, distance))


def composition(assigned: DataFrame, k: int, keys=("arm", "grp", "animal")) -> DataFrame:
    """Per replicate and cluster: count, share and association; empty clusters stay, their association unknown."""
    spine = assigned.select(*keys).distinct().crossJoin(F.broadcast(assigned.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("cluster"))))
    counts = assigned.where("cluster is not null").groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    out = spine.join(counts, [*keys, "cluster"], "left").na.fill(0, ["n", "k"])
    w = Window.partitionBy(*keys)
    return out.withColumn("share_pct", F.when(F.sum("n").over(w) > 0, 100.0 * F.col("n") / F.sum("n").over(w))).withColumn("rate_pct", F.when(F.col("n") > 0, 100.0 * F.col("k") / F.col("n")))


def profiles(assigned: DataFrame, keys=("arm",)) -> DataFrame:
    """Counts and exact medians of the assigned rows per cluster, with the share of zero minima."""
    rows, by = assigned.where("cluster is not null"), [*keys, "cluster"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.avg((F.col("min_diameter") == 0).cast("int"))).alias("zero_min_pct"))
    return counts.join(quantile_columns(rows, {f"median_{c}": (c, 0.5) for c in ("area", "shape", "min_diameter", "max_diameter")}, by), by)


def audit(prepared: DataFrame, key: str = "job") -> DataFrame:
    """What is valid, what is not and why, per section."""
    a, lo, hi = (F.col(c) for c in ("area", "min_diameter", "max_diameter"))
    unknown = lambda *cols: F.count_if(F.greatest(*(finite(c).isNull() for c in cols)))
    return prepared.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_excluded"),
        (100 * F.avg(F.col("valid").cast("int"))).alias("retained_pct"),
        unknown("area", "min_diameter", "max_diameter").alias("unknown_morphology"),
        F.count_if(a <= 0).alias("nonpositive_area"),
        F.count_if(hi <= 0).alias("nonpositive_max"),
        F.count_if(lo > hi).alias("min_above_max"),
        F.count_if(lo < 0).alias("negative_min"),
        F.count_if(F.col("valid") & (lo == 0)).alias("retained_zero_min"),
        F.count_if((lo == 0) & (hi == 0)).alias("both_zero"),
        F.count_if(F.col("b_present").isNull()).alias("unknown_association"),
        F.count_if(F.col("valid") & (finite("x").isNull() | finite("y").isNull())).alias("unknown_places"),
    )


def spread_targets(prepared: DataFrame, limit: int = 6, width: float = 500.0, job: str = "job") -> DataFrame:
    """Excluded rows to look at, per section: one of each reason first, then spread over the bins.

    Rows without a finite place cannot be looked at.  One row per reason and bin
    enters (the least id), which bounds what a section brings to its task.  Each
    choice is the row whose bin is farthest from all chosen bins, ties by bin
    row, bin column and id; reasons are taken in order of their text.
    """
    places = prepared.where("not valid").where(finite("x").isNotNull() & finite("y").isNotNull())
    ex = places.withColumn("bx", F.floor(F.col("x") / width).cast("long")).withColumn("by", F.floor(F.col("y") / width).cast("long"))
    few = ex.groupBy(job, "excluded", "by", "bx").agg(F.min("object_id").alias("object_id"))

    def run(key, pdf):
        pdf = pdf.sort_values(["by", "bx", "object_id"]).reset_index(drop=True)
        bins, chosen = pdf[["bx", "by"]].to_numpy(float), []
        away = np.full(len(pdf), np.inf)

        def choose(rows):
            best = int(rows[away[rows].argmax()])
            chosen.append(best)
            np.minimum(away, ((bins - bins[best]) ** 2).sum(1), out=away)

        for reason in sorted(pdf["excluded"].unique())[:limit]:
            choose(np.flatnonzero(pdf["excluded"].to_numpy() == reason))
        while len(chosen) < min(limit, len(pdf)):
            choose(np.setdiff1d(np.arange(len(pdf)), chosen))
        out = pdf.loc[chosen, ["object_id", "excluded", "bx", "by"]].assign(job=key[0], place=range(1, len(chosen) + 1))
        return out[["job", "object_id", "excluded", "bx", "by", "place"]]

    types = dict(few.dtypes)
    return few.groupBy(job).applyInPandas(run, f"job {types[job]}, object_id {types['object_id']}, excluded string, bx long, by long, place int")
