"""Known answers of small fixtures, and properties that hold on any rows."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import functions as fn
from tessella.operators import cluster, contrast, distribution, geometry, grid, multiset, neighbors, summary
from tessella.plans.design import Design, check_layout, gate, identity_mismatch, in_display_order, metadata_template, missing_design, review_status

KEYS = ("arm", "metric")


@pytest.fixture(scope="module")
def four_jobs(spark):
    """Four A and two B rows per job, with unequal denominators."""
    rows = []
    for j in range(4):
        s = 100.0 * j
        for i, (kind, area, overlap, a, b, dx) in enumerate([("A", 1, 1, True, True, 1), ("A", 1, 0, True, False, 3), ("A", 2, 0.5, True, True, 11), ("A", 8, 0, True, False, 21), ("B", 4, 2, True, True, 1), ("B", 10, 0, False, True, 31)]):
            half = 0.0 if i == 0 else 0.5
            rows.append((j, i, kind, float(area), float(overlap), 100.0 * overlap / area, a, b, 0.0 if i == 0 else 1.0, 2.0, s + dx, s + 1, 1.5, 0.0, float(area), area / 10, s + dx - half, s + dx + half, s + 0.5, s + 1.5))
    return spark.createDataFrame(rows, "job int, object_id long, object_type string, area double, overlap_area double, overlap_pct double, a_present boolean, b_present boolean, min_diameter double, max_diameter double, x double, y double, median_diameter double, inner_area double, outer_area double, intensity double, xmin double, xmax double, ymin double, ymax double")


def replicates(spark, control, treated, arm="arm1"):
    rows = [(arm, "control", i, "m", v) for i, v in enumerate(control)] + [(arm, "treated", 3 + i, "m", v) for i, v in enumerate(treated)]
    return spark.createDataFrame(rows, "arm string, grp string, animal int, metric string, value double")


def test_complete_aggregates(spark):
    rows = [("null", 1.0), ("null", None), ("nan", 1.0), ("nan", math.nan), ("inf", math.inf), ("ok", 1.0), ("ok", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("v", fn.finite("v"))
    got = {r.k: (r.m, r.s) for r in df.groupBy("k").agg(fn.complete_mean("v").alias("m"), fn.complete_sum("v").alias("s")).collect()}
    assert got == {"null": (None, None), "nan": (None, None), "inf": (None, None), "ok": (2.0, 4.0)}
    assert tuple(df.where("k = 'absent'").agg(fn.complete_mean("v"), fn.complete_sum("v")).first()) == (None, 0.0)
    assert tuple(spark.range(1).select(fn.percent(F.lit(1.0), F.lit(0.0)), fn.percent(F.lit(1.0), F.lit(-1.0)), fn.percent(F.lit(1.0), F.lit(4.0))).first()) == (None, None, 25.0)


def test_summary(four_jobs):
    r = summary.object_summary(four_jobs).where("job = 0 and object_type = 'A'").first()
    assert (r.n_objects, r.other_pct, r.mean_overlap_pct, r.weighted_overlap_pct, r.area_median) == (4, 50.0, 31.25, 12.5, 1.5)
    assert r.top_share_pct == pytest.approx(100 * 8 / 12)
    assert (r.zero_min_count, r.any_zero_count, r.zero_box_count, r.zero_box_pct, r.max_intensity, r.median_of_median_diameter) == (1, 1, 1, 25.0, 0.8, 1.5)
    assert len(r) == 32  # the keys and 30 measures
    b = summary.object_summary(four_jobs).where("job = 0 and object_type = 'B'").first()
    assert b.weighted_overlap_pct == pytest.approx(100 * 2 / 14)
    got = sorted((x.threshold, x.kept, x.positive, x.rate_pct) for x in summary.area_sensitivity(four_jobs.where("job = 0"), (0, 1, 2, 8, 9)).collect())
    assert got == [(0.0, 4, 2, 50.0), (1.0, 4, 2, 50.0), (2.0, 2, 1, 50.0), (8.0, 1, 0, 0.0), (9.0, 0, 0, None)]
    strata = {x.stratum: (x.n, x.rate_pct) for x in summary.size_strata(four_jobs.where("job = 0"), (0, 0.03, 0.1, 0.3, 1)).collect()}
    assert strata[4] == (4, 50.0) and strata[0] == (0, None)
    with pytest.raises(ValueError):
        summary.unique_keys(four_jobs, "job")


def test_quality_control(four_jobs):
    bad = four_jobs.withColumn("overlap_area", F.when((F.col("job") == 1) & (F.col("object_id") == 0), 5.0).otherwise(F.col("overlap_area"))).withColumn("object_id", F.when((F.col("job") == 2) & (F.col("object_id") == 5), 4).otherwise(F.col("object_id")))
    got = {r.job: r for r in summary.quality_control(bad).collect()}
    assert got[1].overlap_exceeds_area == 1 and got[1].formula_mismatch == 1 and got[2].duplicate_ids == 1 and got[0].any_zero_diameter == 1
    assert got[0].zero_box == 1 and got[0].reversed_box == 0 and got[0].own_marker_absent == 0 and got[0].area_partition_mismatch == 0 and got[0].missing_values == 0
    odd = four_jobs.withColumns({"xmin": F.col("xmax") + 1, "inner_area": F.lit(2.0), "median_diameter": F.lit(-1.0), "a_present": F.lit(False), "intensity": F.lit(math.nan), "area": F.when(F.col("object_id") == 1, 0.0).otherwise(F.col("area"))})
    r = summary.quality_control(odd).where("job = 3").first()
    assert (r.reversed_box, r.nonzero_inner_area, r.area_partition_mismatch, r.any_negative_diameter, r.diameter_order_mismatch, r.own_marker_absent, r.missing_values, r.nonpositive_area) == (6, 6, 6, 6, 6, 4, 6, 1)
    assert r.max_formula_error == 0.0 and r.formula_mismatch == 1  # an unknown percentage is a mismatch, not an error


def test_quality_control_moves_ids_alone(spark, four_jobs):
    """Ids are counted by an aggregate of their own; sections and ids may be unknown."""
    rows = four_jobs.withColumn("object_id", F.when((F.col("job") == 1) & (F.col("object_id") < 2), None).otherwise(F.col("object_id"))).withColumn("job", F.when(F.col("job") == 3, None).otherwise(F.col("job")))
    frame = summary.quality_control(rows)
    got = {r.job: (r.n_objects, r.duplicate_ids) for r in frame.collect()}
    assert got == {0: (6, 0), 1: (6, 2), 2: (6, 0), None: (6, 0)}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    by_id = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "object_id" in line.split("keys=[")[1].split("]")[0]]
    assert by_id and all(line.split("functions=[")[1].count("count(") <= 1 for line in by_id)


def test_ecdf_and_ranking(four_jobs):
    a = four_jobs.where("job = 0 and object_type = 'A'")
    assert [(r.area, r.n, r.cumulative_pct) for r in distribution.ecdf(a, "area", ("job",)).orderBy("area").collect()] == [(1.0, 2, 50.0), (2.0, 1, 75.0), (8.0, 1, 100.0)]
    assert [r.object_id for r in distribution.top_rows(a, "area", ("job",), 3).orderBy("rank").collect()] == [3, 2, 0]
    assert distribution.first_per_bin(a, ("area",), ("object_id",)).count() == 3


def test_multiset(spark):
    rows = [("first", 1), ("first", 1), ("first", 2), ("first", None), ("second", 1), ("second", 1), ("second", 1), ("second", 3), ("second", None)]
    df = spark.createDataFrame(rows, "run string, v int")
    assert tuple(multiset.shared_signatures(df, "run", ("first", "second"), ("v",)).first()) == (2, 1, 2)
    assert tuple(multiset.shared_signatures(df, "run", ("first", "second"), ("v",), drop_unknown=False).first()) == (3, 1, 2)
    assert multiset.same_keys(df.select("v"), df.select("v").limit(100)) and not multiset.same_keys(df.where("v = 1").select("v"), df.select("v"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["first", "second"]), st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=30), st.randoms())
def test_multiset_ignores_ids_and_order(spark, rows, rnd):
    moved = [(r, v, i + 1) for r, v, i in rows]
    rnd.shuffle(moved)
    one, two = (tuple(multiset.shared_signatures(spark.createDataFrame(x, "run string, v int, object_id int"), "run", ("first", "second"), ("v",)).first()) for x in (rows, moved))
    assert one == two and one[0] * 2 + one[1] + one[2] == len(rows)


def test_grid_conventions(spark, four_jobs):
    a = four_jobs.where("job = 0")
    for convention in ("zero", "closed"):
        g = grid.fraction_grid(a, 10.0, 2, convention)
        assert g.agg(F.sum("n_a") + F.sum("n_b")).first()[0] == 6
        assert [(r.ix, r.n_a, r.display_pct) for r in g.where("supported").collect()] == [(0, 2, 50.0)]
    edge = spark.createDataFrame([(0, 0.0, 0.0), (0, 20.0, 20.0)], "job int, x double, y double")
    n = {c: grid.cells(edge, 10.0, {"n": F.count("*")}, c).where("n > 0").agg(F.max("ix")).first()[0] for c in ("zero", "closed", "points")}
    assert n == {"zero": 2, "closed": 1, "points": 2}
    point = spark.createDataFrame([(0, 20.0, 20.0)], "job int, x double, y double")
    assert grid.cells(point, 10.0, {"n": F.count("*")}, "closed").count() == 1 and grid.cells(point, 10.0, {"n": F.count("*")}, "padded").count() == 0
    for bad in ((0.0, 1, 0.0), (math.inf, 1, 0.0), (1.0, 0, 0.0), (1.0, True, 0.0), (1.0, 1, -1.0)):
        with pytest.raises(ValueError):
            grid.check_parameters(*bad)
    far = spark.createDataFrame([(0, 0.0, 0.0), (0, 1e7, 1e7)], "job int, x double, y double")
    with pytest.raises(ValueError):
        grid.cells(far, 1.0, {"n": F.count("*")})
    grid.check_conserved(grid.analysis_grid(four_jobs, 10.0), four_jobs)
    with pytest.raises(ValueError):
        grid.aligned_rerun(far.withColumn("pair", F.lit(1)), edge.withColumn("pair", F.lit(1)), 10.0)


def test_grid_unknown_is_not_zero(spark):
    rows = [(0, "A", False, 1.0, 1.0), (0, "A", False, 2.0, 2.0), (0, "B", True, 12.0, 1.0)]
    df = spark.createDataFrame(rows, "job int, object_type string, b_present boolean, x double, y double").withColumn("area", F.lit(1.0)).withColumn("overlap_area", F.lit(0.0))
    got = {(r.ix, r.iy): (r.association_pct, r.n_all) for r in grid.analysis_grid(df, 10.0, 2).collect()}
    assert got[0, 0] == (0.0, 2) and got[1, 0] == (None, 1)


def test_smoothing(four_jobs):
    g = grid.fraction_grid(four_jobs.where("job = 0"), 10.0, 2)
    r = grid.smoothed_fraction(g, 1.0, 2).where("smoothed_pct is not null").first()
    assert r.smoothed_pct == pytest.approx(100 * (1 + math.exp(-0.5)) / (2 + math.exp(-0.5) + math.exp(-2)))


def test_equal_maps(spark):
    rows = [("a", "control", 0, 0, v) for v in (10.0, 90.0, 50.0)] + [("a", "control", 1, 0, v) for v in (None, None, 20.0)]
    got = {r.ix: (r.n, r["mean"]) for r in grid.equal_maps(spark.createDataFrame(rows, "arm string, grp string, ix int, iy int, v double"), "v").collect()}
    assert got == {0: (3, 50.0), 1: (1, None)}


def test_contrasts(spark):
    long = replicates(spark, [20.0, 40.0, 60.0], [0.0, 10.0, 20.0])
    assert contrast.contrast(long).first().difference == 30.0
    r = contrast.leave_pair_out(long).first()
    assert (r.n_pairs, r.low, r.high) == (9, 15.0, 45.0)
    d = [x.difference for x in contrast.cross_replicate(long).collect()]
    assert (min(d), max(d), len(d)) == (0.0, 60.0, 9)
    both = {x.direction: x for x in contrast.directions(long).collect()}
    a, b = both["control - treated"], both["treated - control"]
    assert a.difference == -b.difference and a.ratio * b.ratio == pytest.approx(1) and a.se == pytest.approx(math.sqrt(400 / 3 + 100 / 3))
    e = contrast.exact_allocation(replicates(spark, [80.0, 90.0, 100.0], [0.0, 10.0, 20.0])).first()
    assert (e.n_allocations, e.p, e.observed_difference) == (20, pytest.approx(0.1), 80.0)
    unknown = replicates(spark, [80.0, None, 100.0], [0.0, 10.0, 20.0])
    c = contrast.contrast(unknown).first()
    assert (c.control_mean, c.difference, c.control_n) == (None, None, 2) and contrast.exact_allocation(unknown).first().p is None


def test_strict_contrast(spark):
    r = contrast.strict_contrast(replicates(spark, [20.0, 40.0, 60.0], [0.0, 10.0, 20.0])).first()
    assert (r.difference, r.low, r.high) == (-30.0, -45.0, -15.0)
    for control, treated in (([20.0, 40.0], [0.0, 10.0, 20.0]), ([20.0, None, 60.0], [0.0, 10.0, 20.0]), ([20.0, math.nan, 60.0], [0.0, 10.0, 20.0])):
        with pytest.raises(ValueError):
            contrast.strict_contrast(replicates(spark, control, treated))


@pytest.mark.parametrize("values", [[3.0], [1.0] * 50, [1.0] * 40 + [2.0, 5.0, 9.0], list(range(200)), [-1.5, 0.0, 0.0, 1e-300, 1e300]])
def test_quantiles_and_shares(spark, values):
    rng = np.random.default_rng(len(values))
    rows = [("a", float(v)) for v in values] + [("b", None), ("c", 7.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(k), None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(3)
    wanted = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {(r.k, r.probability): r.value for r in distribution.quantiles(df, "v", ("k",), wanted).collect()}
    assert got == {**{("a", p): pytest.approx(float(np.quantile(values, p))) for p in wanted}, **{("c", p): 7.0 for p in wanted}}
    if min(values) >= 0:
        share = {r.k: r.top_share_pct for r in distribution.top_share(df, ("k",), "v", 0.1).collect()}
        top = sorted(map(float, values))[-max(1, math.ceil(0.1 * len(values))) :]
        assert share["a"] == pytest.approx(100 * sum(top) / sum(values)) and share["c"] == 100
    steps = distribution.ecdf(df, "v", ("k",)).where("k = 'a'").orderBy("v").collect()
    assert [(r.v, r.n) for r in steps] == [(v, list(map(float, values)).count(v)) for v in sorted(set(map(float, values)))] and steps[-1].cumulative_pct == 100
    ranked = distribution.concentration(df.withColumn("object_id", F.monotonically_increasing_id()), "v", ("k",)).where("k = 'a'").orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, len(values) + 1))


def test_standardisation(spark):
    rows = []
    for i in range(6):
        n = (90, 10) if i < 3 else (10, 90)
        for s, rate in enumerate((0.8, 0.2)):
            rows.append(("arm1", "control" if i < 3 else "treated", i, s, n[s], int(n[s] * rate)))
    cells = spark.createDataFrame(rows, "arm string, grp string, animal int, stratum int, n long, k long")
    got = {r.metric: r.difference for r in contrast.standardized_contrast(cells).collect()}
    assert got["raw"] == pytest.approx(48) and got["restricted"] == pytest.approx(48) and got["standardized"] == pytest.approx(0)
    few = cells.withColumn("n", F.when((F.col("animal") == 0) & (F.col("stratum") == 1), 9).otherwise(F.col("n")))
    assert {r.stratum: r.eligible for r in contrast.support(few).collect()} == {0: True, 1: False}


def test_adjusted_rand(spark):
    ari = lambda rows: contrast.adjusted_rand(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()[0]
    assert ari([(0, 1), (0, 1), (1, 0), (1, 0)]) == 1
    assert ari([(0, 0), (0, 1), (1, 0), (1, 1)]) == pytest.approx(-0.5)
    assert ari([(0, 0), (0, 0), (0, 1), (0, 1)]) == 0


@pytest.mark.parametrize("width", [None, 50.0, 250.0, 3000.0])
def test_nearest_equals_brute_force(spark, width):
    rng = np.random.default_rng(int(width or 1))
    q, t = rng.exponential(300, (80, 2)), np.vstack([rng.exponential(200, (40, 2)), [[9000.0, 9000.0]]])
    rows = [(0, i, "q", *map(float, v)) for i, v in enumerate(q)] + [(0, 1000 + i, "t", *map(float, v)) for i, v in enumerate(t)] + [(1, 5, "q", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "job int, object_id long, side string, x double, y double")
    got = {(r.job, r.object_id): r.distance for r in neighbors.nearest(df.where("side = 'q'"), df.where("side = 't'"), width).collect()}
    for i, v in enumerate(q):
        assert got[0, i] == pytest.approx(np.sqrt(((t - v) ** 2).sum(1)).min())
    assert got[1, 5] is None


def test_nearest_in_a_dense_place(spark):
    """Half of both sides in a spot of one cell's size, some targets on one place: no cell stays crowded, distances are exact."""
    rng = np.random.default_rng(6)
    q = np.vstack([rng.uniform(0, 1e5, (3000, 2)), 500 + rng.uniform(0, 3, (3000, 2))])
    t = np.vstack([rng.uniform(0, 1e5, (3000, 2)), 500 + rng.uniform(0, 3, (3000, 2)), np.tile([[501.0, 501.0]], (2000, 1))])
    frame = lambda p: spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(p)], "job int, object_id long, x double, y double")
    queries, targets = frame(q), frame(t)
    places = targets.select("job", "x", "y").distinct()
    width = neighbors.adapted_width(places)
    assert width < neighbors.fitting_width(places) / 16
    assert neighbors._cells(places, width).groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= neighbors.DENSE
    got = {r.object_id: r.distance for r in neighbors.nearest(queries, targets).collect()}
    exact = geometry.nearest_distances(q, np.unique(t, axis=0))
    assert len(got) == len(q) and all(got[i] == pytest.approx(d) for i, d in enumerate(exact))


def test_nearest_asks_once_for_each_place(spark):
    """Rows of one place are one question, which goes to few cells; rows without a place stay, with no distance."""
    rng = np.random.default_rng(3)
    p, q = np.round(rng.uniform(0, 100, (400, 2)), 1), np.round(rng.uniform(0, 100, (300, 2)), 1)
    q = np.vstack([q, p[:100]])
    rows = [(0, f"{i}-{c}", *map(float, v)) for i, v in enumerate(q) for c in range(5)] + [(0, "unplaced", None, 1.0), (1, "alone", 1.0, 1.0)]
    queries = spark.createDataFrame(rows, "job int, object_id string, x double, y double")
    targets = spark.createDataFrame([(0, *map(float, v)) for v in p] + [(0, None, 1.0)], "job int, x double, y double")
    once = neighbors.place_distances(queries, targets).collect()
    assert len(once) == len(np.unique(q, axis=0))
    cells = neighbors._reached(queries.where("x is not null").withColumn("_reach", F.lit(5.0)), 10.0)
    assert 3.5 < cells.count() / (len(rows) - 1) < 4.5
    got = {r.object_id: r.distance for r in neighbors.nearest(queries, targets).collect()}
    exact = geometry.nearest_distances(q, np.unique(p, axis=0))
    assert len(got) == len(rows) and got["unplaced"] is None and got["alone"] is None
    assert all(got[f"{i}-{c}"] == pytest.approx(d) for i, d in enumerate(exact) for c in range(5))


def test_nearest_to_passes_over_unknown_values(spark):
    rows = [(1, "z", 1.0), (1, "b", 2.0), (1, "a", 2.0), (1, "c", 9.0), (1, "0", None), (2, "u", None)]
    df = spark.createDataFrame(rows, "job int, object_id string, v double")
    assert [tuple(r) for r in distribution.nearest_to(df, "v", 0.5, ("job",)).collect()] == [(1, 2.0, "a", 2.0)]


def test_identical_signatures(spark):
    rows = [(r, k, x, b, y) for r, k, x, b, y in [("f", 1, 0.5, True, None), ("f", 1, 0.5, True, None), ("s", 1, 0.5, True, None), ("f", 1, 1.0, None, 2.0), ("s", 1, None, None, 2.0), ("f", 1, -0.0, False, 1.0), ("s", 1, 0.0, False, 1.0), ("s", 1, 0.0, False, 1.0), ("f", 2, 3.0, True, 3.0)]]
    df = spark.createDataFrame(rows, "run string, k int, x double, b boolean, y double")
    got = {r.k: tuple(r)[1:] for r in multiset.identical_signatures(df, "run", ("f", "s"), ("x", "b", "y"), ("k",), False).collect()}
    assert got == {1: (4, 4, 2, 2, 2, 50.0), 2: (1, 0, 0, 1, 0, None)}
    got = {r.k: tuple(r)[1:] for r in multiset.identical_signatures(df, "run", ("f", "s"), ("x", "b", "y"), ("k",)).collect()}
    assert got == {1: (1, 2, 1, 0, 1, 50.0), 2: (1, 0, 0, 1, 0, None)}
    assert multiset.identical_signatures(df.limit(0), "run", ("f", "s"), ("x", "b", "y"), ("k",)).count() == 0


def test_allocations_by_halves(spark, monkeypatch):
    """As many replicates as enumeration can take give the same p both ways; 30 are counted in seconds."""
    rng = np.random.default_rng(12)
    for n, k in ((6, 3), (9, 4), (12, 6)):
        for values in (rng.normal(0, 5, n), rng.integers(0, 4, n) * 1.0):
            low, high = sorted(rng.normal(values.mean() * k, 3, 2))
            sums = [sum(values[list(c)]) for c in itertools.combinations(range(n), k)]
            assert contrast.tail_counts(values, k, low, high) == (len(sums), sum(x <= low or x >= high for x in sums))
            assert contrast.tail_counts(values, k, high, low) == (len(sums), len(sums))
    rows = [("a", m, "control" if i < n // 2 else "treated", i, None if m == "gap" and i == 2 else float(v)) for m, n in (("six", 6), ("ties", 12), ("gap", 6)) for i, v in enumerate(rng.normal(0, 1, n) if m == "six" else rng.integers(0, 3, n))]
    long = spark.createDataFrame(rows, "arm string, metric string, grp string, animal int, value double")
    plain = {r.metric: r for r in contrast.exact_allocation(long).collect()}
    monkeypatch.setattr(contrast, "MAX_ALLOCATED", 2)
    halves = {r.metric: r for r in contrast.exact_allocation(long).collect()}
    assert set(plain) == set(halves)
    for m, r in plain.items():
        assert (halves[m].n_allocations, halves[m].p) == (r.n_allocations, None if r.p is None else pytest.approx(r.p))
    assert plain["gap"].p is None and halves["six"].observed_difference == pytest.approx(plain["six"].observed_difference)
    thirty = spark.createDataFrame([("a", "m", "control" if i < 15 else "treated", i, float(i % 7) + (i < 15)) for i in range(30)], long.schema)
    r = contrast.exact_allocation(thirty).first()
    assert r.n_allocations == math.comb(30, 15) and 0 < r.p < 1
    with pytest.raises(ValueError):
        contrast.exact_allocation(spark.createDataFrame([("a", "m", "control", i, 1.0) for i in range(41)], long.schema))


def test_polygons(spark):
    shape = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(0, shape((0, 0), (1, 0), (2, 0), (2, 2), (0, 2))), (1, shape((0, 0), (1, 1), (2, 2))), (2, shape((0, 0), (1, 0))), (3, shape((0, 0), (6, 0), (6, 6), (5, 6), (5, 1), (0, 1)))]
    got = dict(spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>").select("i", fn.polygon_centroid("p").alias("c")).collect())
    assert (got[0].x, got[0].y) == (1.0, 1.0) and got[1] is None and got[2] is None and got[3] is None


def test_flips_keep_distances(spark):
    pts = spark.createDataFrame([(i, float(i * i), float(3 * i), o) for i in range(4) for o in fn.FLIPS], "i int, x double, y double, o string")
    tx, ty = fn.flipped("x", "y", F.lit(4.0), F.lit(3.0), "o")
    rows = pts.select("i", "o", tx.alias("x"), ty.alias("y")).collect()
    dist = lambda o: [round(math.dist((a.x, a.y), (b.x, b.y)), 9) for a in rows for b in rows if a.o == b.o == o]
    assert dist("none") == dist("x") == dist("y") == dist("both")


def test_grid_morphology():
    ring = np.ones((12, 12), dtype=bool)
    ring[3:9, 3:9] = False
    hole = geometry.void_cells(ring)
    assert hole.sum() == geometry.label(hole)[0].astype(bool).sum() and hole[5, 5] and not hole[0, 0]
    assert geometry.void_cells(np.ones((8, 8), dtype=bool)) is None
    path = geometry.outline(np.ones((1, 2), dtype=bool))
    assert len(path) == 6 and set(path) == {(0.5, 0.0), (1.5, 0.0), (2.0, 0.5), (1.5, 1.0), (0.5, 1.0), (0.0, 0.5)}
    edge = geometry.boundary_cells(np.ones((4, 4), dtype=bool))
    assert edge.sum() == 12 and not edge[1:3, 1:3].any()
    assert geometry.centroid_inside([(0, 0), (2, 0), (2, 2), (0, 2)]) == (1.0, 1.0)
    assert geometry.centroid_inside([(0, 0), (6, 0), (6, 6), (5, 6), (5, 1), (0, 1)]) is None and geometry.centroid_inside([(0, 0), (1, 1), (2, 2)]) is None
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 3), (20, 31)):
        outside = ~np.pad(rng.random(shape) < 0.7, 1)
        at = np.argwhere(outside)
        assert (geometry.squared_distance(outside) == np.array([[((at - (y, x)) ** 2).sum(1).min() for x in range(outside.shape[1])] for y in range(outside.shape[0])])).all()
    assert geometry.clearance(np.ones((3, 3), dtype=bool), 10.0)[1, 1] == pytest.approx(20 - 10 * math.sqrt(2) / 2)
    assert geometry.boundary_cells(np.zeros((3, 3), dtype=bool)) is None


def test_boundary_scores(spark):
    line = [(0, float(i), 0.0) for i in range(100)]
    far = line + [(0, 50.0, 1000.0 + i) for i in range(15)]
    a, b = (spark.createDataFrame(r, "k int, x double, y double") for r in (line, far))
    r = geometry.boundary_scores(a, b, ("k",)).first()
    assert r.score == 0 and r.tail > 800


def test_alignment(spark):
    base = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 5.0), (0.0, 3.0)]
    rows = [(0, x, y) for x, y in base] + [(1, -x, y) for x, y in base] + [(2, x, -y) for x, y in base]
    edges = spark.createDataFrame(rows, "job int, x double, y double")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0)], "job int, cx double, cy double, cue_dy double")
    got = {r.job: r for r in geometry.alignment_proposals(edges, centres, 0).collect()}
    assert got[1].orientation == "x" and got[1].score == 0 and not got[1].cue_conflict and not got[1].approved
    assert got[2].cue_conflict and got[2].orientation in ("none", "x")
    assert geometry.stability(geometry.alignment_proposals(edges, centres, 0), geometry.alignment_proposals(edges, centres, 0)).where("not stable").count() == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for animal in range(6):
        for mean in ((-2, 0.15), (-0.7, 0.5), (0.5, 0.85)):
            for la, sh in rng.normal(mean, (0.1, 0.03), (40, 2)):
                rows.append(("arm1", "control" if animal < 3 else "treated", animal, animal, i, "A", float(10**la), float(max(0, min(1, sh)) * 3), 3.0, bool(rng.random() < 0.5), float(i), float(i)))
                i += 1
    return spark.createDataFrame(rows, "arm string, grp string, animal int, job int, object_id long, object_type string, area double, min_diameter double, max_diameter double, b_present boolean, x double, y double")


def test_clustering(blobs):
    valid = cluster.prepare(blobs).where("valid")
    model = cluster.fit(cluster.balanced_sample(valid, 60, 1), 3)
    again = cluster.fit(cluster.balanced_sample(cluster.prepare(blobs.repartition(7).withColumn("b_present", ~F.col("b_present")).withColumn("x", -F.col("x"))).where("valid"), 60, 1), 3)
    assert model == again
    assigned = valid.withColumn("cluster", model.assign())
    assert {r["count"] for r in assigned.groupBy("cluster").count().collect()} == {240}
    parts = cluster.composition(assigned, 3)
    assert parts.groupBy("animal").agg(F.sum("share_pct").alias("s")).where("abs(s - 100) > 1e-9").count() == 0
    out = cluster.leave_one_out(valid, model, 60)
    assert len(out) == 6 and all(r["agreement_pct"] == 100 and r["ari"] == 1 and r["n"] == 120 and set(r["jaccard"].values()) == {1.0} for r in out)
    assert all(r["left_out"] not in {x.animal for x in cluster.balanced_sample(valid.where(F.col("animal") != r["left_out"]), 60, 1).collect()} for r in out[:1])
    wide = assigned.withColumn("d", cluster.centroid_distance(model))
    rows = wide.select("job", "cluster", "object_id", "d").collect()
    for t in cluster.review_targets(wide, "d").collect():
        mine = sorted((r.d, r.object_id) for r in rows if (r.job, r["cluster"]) == (t.job, t["cluster"]))
        aim = mine[0][0] if t.selection == "typical" else float(np.quantile([d for d, _ in mine], 0.99))
        assert (t.d, t.object_id) == min(((abs(d - aim), i, d) for d, i in mine))[:0:-1]
    assert cluster.display_sample(assigned, 7).groupBy("job").count().where("count <> 7").count() == 0
    area = cluster.area_only(cluster.prepare(blobs.withColumn("min_diameter", F.lit(None).cast("double"))))
    only = cluster.fit(cluster.balanced_sample(area, 60, 1), 3, features=("log_area",))
    assert {r["count"] for r in area.groupBy(only.assign()).count().collect()} == {240}
    sums = {r["cluster"]: r.difference for r in contrast.cluster_contrasts(parts).where("metric = 'share_pct'").collect()}
    assert sum(sums.values()) == pytest.approx(0)


def test_morphology_exclusions(spark):
    rows = [(0, 1.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0), (2, math.nan, 1.0, 2.0), (3, 1.0, 2.0, 1.0), (4, None, 1.0, 1.0), (5, 0.0, -1.0, -2.0), (6, 1.0, math.inf, 1.0)]
    df = spark.createDataFrame(rows, "object_id long, area double, min_diameter double, max_diameter double").withColumn("object_type", F.lit("A")).withColumn("job", F.lit(0)).withColumn("x", F.col("object_id") * 1.0).withColumn("y", F.lit(0.0))
    got = {r.object_id: (r.valid, r.excluded) for r in cluster.prepare(df).collect()}
    assert got[0] == (True, None) and got[1] == (False, "both diameters zero") and got[2] == got[4] == (False, "unknown area") and got[3] == (False, "minimum above maximum")
    assert got[5] == (False, "area not positive; largest diameter not positive; negative minimum; minimum above maximum") and got[6] == (False, "unknown diameter")
    r = cluster.audit(cluster.prepare(df.withColumn("b_present", F.lit(None).cast("boolean")))).first()
    assert (r.n, r.n_valid, r.retained_zero_min, r.both_zero, r.unknown_morphology, r.nonpositive_area, r.unknown_association) == (7, 1, 1, 1, 3, 1, 7)
    chosen = cluster.spread_targets(cluster.prepare(df), 3).orderBy("place").collect()
    assert [r.excluded for r in chosen] == ["area not positive; largest diameter not positive; negative minimum; minimum above maximum", "both diameters zero", "minimum above maximum"]


def test_spread_targets_are_the_farthest(spark):
    rows = [(i, 0.0 if i % 5 else -1.0, 500.0 * (i * 7 % 13), 500.0 * (i * 3 % 11)) for i in range(60)] + [(100, 0.0, math.nan, 1.0), (101, 0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "object_id long, min_diameter double, x double, y double").withColumns({"area": F.lit(1.0), "max_diameter": F.lit(0.0), "object_type": F.lit("A"), "job": F.lit(0)})
    got = [r.object_id for r in cluster.spread_targets(cluster.prepare(df)).orderBy("place").collect()]
    reason = {i: "both diameters zero" if m == 0 else "largest diameter not positive; negative minimum" for i, m, *_ in rows}
    bins = {i: (int(y // 500), int(x // 500)) for i, _, x, y in rows[:60]}
    first: dict = {}
    for i in sorted(bins, key=lambda i: (*bins[i], i)):
        first.setdefault((reason[i], bins[i]), i)
    order, want = list(first.values()), []
    away = lambda i: min(((bins[i][0] - bins[j][0]) ** 2 + (bins[i][1] - bins[j][1]) ** 2 for j in want), default=math.inf)
    for text in sorted(set(reason.values())):
        want.append(max((i for i in order if reason[i] == text), key=away))
    while len(want) < 6:
        want.append(max((i for i in order if i not in want), key=away))
    assert got == want


def test_design(spark):
    rows = [(a * 6 + i, i, "control" if i < 3 else "treated", f"arm{a + 1}") for a in range(2) for i in range(6)]
    schema = "job int, animal int, grp string, arm string"
    meta = spark.createDataFrame(rows, schema)
    Design().check_metadata(meta)
    for bad in (rows[:-1], rows + rows[:1], [(*rows[0][:2], "treated", "arm1"), *rows[1:]]):
        with pytest.raises(ValueError):
            Design().check_metadata(spark.createDataFrame(bad, schema))
    objects = meta.select("job").withColumn("object_type", F.lit("A")).withColumn("area", F.lit(1.0))
    Design().check_objects(objects, meta)
    assert Design().attach(objects, meta).count() == 12
    for bad in (objects.where("job > 0"), objects.withColumn("object_type", F.lit("C")), objects.withColumn("area", F.lit(-1.0))):
        with pytest.raises(ValueError):
            Design().check_objects(bad, meta)
    known = {i: "control" if i < 3 else "treated" for i in range(6)}
    Design(assignment=known).check_metadata(meta)
    for bad in (Design(assignment={**known, 0: "treated"}), Design(assignment={})):
        with pytest.raises(ValueError, match="recorded"):
            bad.check_metadata(meta)
    with pytest.raises(ValueError, match="unknown identity"):
        Design().check_metadata(spark.createDataFrame([(*rows[0][:2], None, "arm1"), *rows[1:]], schema))
    with pytest.raises(ValueError, match="more than"):
        Design().check_metadata(spark.range(20_000).select(F.col("id").cast("int").alias("job"), F.lit(0).alias("animal"), F.lit("control").alias("grp"), F.lit("arm1").alias("arm")))
    found = identity_mismatch(meta, meta.where("job > 0").withColumn("grp", F.when(F.col("job") == 5, "control").otherwise(F.col("grp"))), ("animal", "grp")).collect()
    assert sorted(map(tuple, found)) == [(0, "job"), (5, "grp")]
    assert [r.display_order for r in in_display_order(spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "k string"), "k", ("a", "b")).collect()] == [1, 0, 2, 2]
    boxes = objects.withColumns({"xmin": F.lit(0.0), "xmax": F.lit(1.0), "ymin": F.lit(0.0), "ymax": F.lit(1.0)})
    images = meta.withColumns({"image_id": F.col("animal").cast("string"), "image_label": F.concat(F.lit("Image "), F.col("animal").cast("string"))})
    check_layout(boxes, images)
    for o, m in (
        (boxes.withColumn("xmax", F.lit(-1.0)), images), (boxes.withColumn("ymin", F.lit(math.nan)), images), (boxes.where("job > 0"), images), (boxes, images.where("job > 0")),
        (boxes, images.withColumn("image_label", F.col("job").cast("string"))), (boxes, images.withColumn("image_label", F.lit(" "))), (boxes, images.withColumn("grp", F.lit("control"))),
    ):
        with pytest.raises(ValueError, match="layout"):
            check_layout(o, m)
    blank = metadata_template(meta)
    assert missing_design(blank, ("animal", "grp")).where("missing = 'animal, grp'").count() == 12


def test_review_gate(spark):
    from tessella.sources import default_reviews

    rows = [(a * 6 + i, i, "control" if i < 3 else "treated", f"arm{a + 1}") for a in range(2) for i in range(6)]
    meta = spark.createDataFrame(rows, "job int, animal int, grp string, arm string")
    objects, blank = meta.select("job"), default_reviews(meta)
    assert len(gate(blank, objects)) == 12
    poly = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    yes = F.lit(True)
    ready = blank.withColumn("reviewed_polygon", poly).withColumn("landmark_reviewed", yes).withColumn("orientation_reviewed", yes).withColumn("scale_common_confirmed", yes).withColumn("support_reviewed", yes).withColumn("support_qc", yes).withColumn("reviewer", F.lit("r"))
    assert gate(ready, objects) == [] and gate(ready.where("job > 0"), objects) and gate(ready.unionByName(ready.where("job = 0")), objects)
    assert review_status(ready.withColumn("orientation", F.lit("x"))).first().reasons == "flip needs a second reviewer"
    with pytest.raises(TypeError):
        review_status(ready.withColumn("support_qc", F.lit("yes")))


def test_layout(spark):
    rows = [(j, "control" if j < 3 else "treated", "A" if i else "B", j < 3, 10.0 * j + i) for j in range(6) for i in range(2)]
    df = spark.createDataFrame(rows, "job int, grp string, object_type string, b_present boolean, x double").withColumn("arm", F.lit("image"))
    r = geometry.layout_audit(df).first()
    assert (r.x_order, r.gap, r.contrast) == ("control lower", 9.0, 100.0)
    assert geometry.layout_audit(df.withColumn("x", F.lit(1.0))).first().x_order == "overlap"


def test_layout_extents_contrasts_and_verdict(spark):
    """Groups apart in one image, touching in another; an unknown flag; an image with one group."""
    rows = [("i", "control", 1, 1, "A", True, 0.0, 4.0), ("i", "control", 1, 1, "B", True, 2.0, 9.0), ("i", "treated", 2, 2, "A", False, 10.0, 12.0), ("k", "control", 1, 3, "A", True, 0.0, 5.0), ("k", "treated", 2, 4, "A", None, 5.0, 6.0), ("l", "control", 3, 5, "A", True, 0.0, 1.0)]
    objects = spark.createDataFrame([(*r, 1.0, 3.0) for r in rows], "image string, grp string, animal int, job int, object_type string, b_present boolean, xmin double, xmax double, ymin double, ymax double").withColumn("arm", F.lit("a"))
    extents = geometry.section_extents(objects)
    first = extents.where("job = 1").first()
    assert (first.x_min, first.x_max, first.x_mid, first.x_size, first.y_size, first.n_objects, first.n_a, first.association_pct) == (0, 9, 4.5, 9, 2, 2, 1, 100)
    assert extents.where("job = 4").first().association_pct is None
    got = {r.image: r for r in geometry.layout_contrasts(extents).collect()}
    assert (got["i"].x_order, got["i"].gap, got["i"].difference, got["i"].treated_animals) == ("control lower", 1.0, 100.0, "2")
    assert (got["k"].x_order, got["k"].gap, got["k"].difference, got["k"].control_mean) == ("overlap", 0.0, None, None)
    assert (got["l"].x_order, got["l"].gap, got["l"].difference) == ("one group", None, None)
    v = geometry.layout_verdict(extents).first()
    assert (v.n_sections, v.n_images, v.n_comparisons, v.consistent, v.order, v.n_known, v.n_positive_contrasts, v.n_negative_contrasts, v.all_positive) == (5, 3, 3, False, None, 1, 1, 0, False)
    v = geometry.layout_verdict(extents.where("image = 'i'")).first()
    assert (v.consistent, v.order, v.all_positive, v.control_x_max, v.treated_x_min) == (True, "control lower", True, 9.0, 10.0)
    nothing = geometry.layout_verdict(extents.limit(0)).first()
    assert (nothing.n_sections, nothing.consistent, nothing.all_positive) == (0, False, False)


def test_estimands_and_both_directions(spark):
    rows = [("a", "control" if i < 3 else "treated", i, 10 * (i + 1), 2 * i, 50.0 - i, None if i == 5 else 3.0 * i) for i in range(6)]
    got = contrast.normalization_audit(spark.createDataFrame(rows, "arm string, grp string, animal int, n long, k long, standardized double, area_overlap_pct double")).first()
    rate = [100 * r[4] / r[3] for r in rows]
    assert got.equal_rate == pytest.approx(sum(rate[:3]) / 3 - sum(rate[3:]) / 3) and got.equal_standardized == pytest.approx(3.0)
    assert got.equal_area_overlap is None and got.pooled_rate == pytest.approx(100 * 6 / 60 - 100 * 24 / 150)
    few = contrast.normalization_audit(spark.createDataFrame([(*r[:4], None if r[2] == 1 else r[4], *r[5:]) for r in rows], "arm string, grp string, animal int, n long, k long, standardized double, area_overlap_pct double")).first()
    assert few.pooled_rate is None and few.equal_rate is None and few.equal_standardized is not None
    long = spark.createDataFrame([("a", "m", g, i, float(v)) for g, values in (("control", (1, 2, 6)), ("treated", (4, 5, 9))) for i, v in enumerate(values)], "arm string, metric string, grp string, animal int, value double")
    ways = {r.direction: r for r in contrast.directions(long).collect()}
    one, back = ways["control - treated"], ways["treated - control"]
    assert (one.difference, one.low, one.high) == (-3.0, 1.5 - 7.0, 4.0 - 4.5) and (back.difference, back.low, back.high) == (3.0, 0.5, 5.5)


def test_shuffled_rows_change_nothing(spark, four_jobs):
    rows = four_jobs.collect()
    random.Random(0).shuffle(rows)
    moved = spark.createDataFrame(rows, four_jobs.schema).repartition(3)
    for f in (summary.object_summary, summary.quality_control, lambda d: grid.analysis_grid(d, 10.0), lambda d: distribution.concentration(d, "area", ("job",))):
        assert sorted(map(str, f(four_jobs).collect())) == sorted(map(str, f(moved).collect()))
