"""Gated registration, grid pyramids and boundary distances against brute force."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import geometry, grid, pyramid
from tessella.plans.design import Design
from tessella.plans.registration import condition_registration

META = [(a * 6 + i, i, "control" if i < 3 else "treated", f"arm{a + 1}") for a in range(2) for i in range(6)]
ORIENTATIONS = ("none", "x", "y", "both")


@pytest.fixture(scope="module")
def study(spark):
    rnd = random.Random(5)
    rows = [(j, *rest, "A" if rnd.random() < 0.7 else "B", rnd.random() < 0.4, rnd.uniform(-900, 1300), rnd.uniform(-900, 1200)) for j, *rest in META for _ in range(rnd.randint(60, 140))]
    objects = spark.createDataFrame(rows, "job int, animal int, grp string, arm string, object_type string, b_present boolean, x double, y double")
    polygon = lambda j: [{"x": 100.0 + j, "y": 50.0}, {"x": 300.0 + j, "y": 50.0}, {"x": 300.0 + j, "y": 250.0}, {"x": 100.0 + j, "y": 250.0}]
    reviews = [(*m, polygon(m[0]), True, ORIENTATIONS[m[0] % 4], True, True, True, True, "r", "s") for m in META]
    schema = "job int, animal int, grp string, arm string, reviewed_polygon array<struct<x:double,y:double>>, landmark_reviewed boolean, orientation string, orientation_reviewed boolean, scale_common_confirmed boolean, support_reviewed boolean, support_qc boolean, reviewer string, second_reviewer string"
    return rows, objects, spark.createDataFrame(reviews, schema)


def test_registration_equals_plain_maps(study):
    rows, objects, records = study
    got = condition_registration(objects, records, Design(), 1000.0, 4)
    assert got.ready and (got.approved, got.total, got.needs_review) == (12, 12, ())
    counts = defaultdict(lambda: [0, 0])
    for j, _, grp, arm, kind, marked, x, y in rows:
        if kind == "A":
            sx, sy = {"none": (1, 1), "x": (-1, 1), "y": (1, -1), "both": (-1, -1)}[ORIENTATIONS[j % 4]]
            cell = arm, math.floor((sx * (x - 200 - j) + 30_000) / 1000), math.floor((sy * (y - 150) + 30_000) / 1000)
            counts[cell, grp, j][0] += 1
            counts[cell, grp, j][1] += marked
    means = defaultdict(list)
    for (cell, grp, _), (n, k) in counts.items():
        if n >= 4:
            means[cell, grp].append(100 * k / n)
    maps = got.maps.collect()
    assert len(maps) == 2 * 60 * 60
    for r in maps:
        side = {g: means.get(((r.arm, r.ix, r.iy), g), []) for g in ("control", "treated")}
        mean = {g: sum(v) / 3 if len(v) == 3 else None for g, v in side.items()}
        assert (r.control_n, r.treated_n) == (len(side["control"]), len(side["treated"]))
        assert r.control_mean == pytest.approx(mean["control"]) and r.treated_mean == pytest.approx(mean["treated"])
        assert r.difference == (pytest.approx(mean["control"] - mean["treated"]) if None not in mean.values() else None)
    assert any(r.difference for r in maps)


def test_registration_is_withheld(spark, study, monkeypatch):
    _, objects, records = study
    job, never = F.col("job"), pd.NA
    faulty = {
        "11 of 12 section reviews": records.where("job > 0"),
        "13 of 12 section reviews": records.unionByName(records.where("job = 3")),
        "0 of 12 section reviews": records.limit(0),
        "several records": records.where("job > 0").unionByName(records.where("job = 3")),
        "every replicate in every arm": records.withColumn("animal", F.when(job == 4, 5).otherwise(F.col("animal"))),
        "recorded assignment": records.withColumn("grp", F.when(job == 4, "control").otherwise(F.col("grp"))),
        "name different sections": records.withColumn("job", F.when(job == 4, 40).otherwise(job)),
        "11 of 12 sections are approved": records.withColumn("reviewer", F.when(job == 4, " ").otherwise(F.col("reviewer"))),
    }
    # None of these gets as far as the parameters, which are wrong too.
    for why, bad in faulty.items():
        got = condition_registration(objects, bad, Design(), never, 0)
        assert not got.ready and got.maps is None and why in got.message
    assert condition_registration(objects, faulty["11 of 12 sections are approved"], Design()).needs_review == ((4, "no reviewer"),)
    swapped = {i: "treated" if i < 3 else "control" for i in range(6)}
    assert "recorded assignment" in condition_registration(objects, records, Design(assignment=swapped)).message


def test_registration_errors(spark, study):
    _, objects, records = study
    job, flat = F.col("job"), F.array(*(F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(3)))
    with pytest.raises(ValueError, match="without a centroid"):
        condition_registration(objects, records.withColumn("reviewed_polygon", F.when(job == 2, flat).otherwise(F.col("reviewed_polygon"))), Design())
    with pytest.raises(ValueError, match="discrete flips"):
        condition_registration(objects, records.withColumn("orientation", F.lit("turned")), Design())
    for width, support in ((0.0, 1), (float("nan"), 1), (1000.0, 0), (1000.0, True), (10.0, 1)):
        with pytest.raises(ValueError):
            condition_registration(objects, records, Design(), width, support)
    with pytest.raises(ValueError, match="outside the registered frame"):
        condition_registration(objects.withColumn("x", F.when((job == 1) & (F.col("object_type") == "A"), 1e6).otherwise(F.col("x"))), records, Design())


# --- pyramid ----------------------------------------------------------------------


def test_roots():
    assert pyramid.roots([1000, 250, 500, 300, 900]) == {250.0: 250.0, 300.0: 300.0, 500.0: 250.0, 900.0: 300.0, 1000.0: 250.0}
    with pytest.raises(ValueError):
        pyramid.roots([0])


@pytest.fixture(scope="module")
def scattered(spark):
    rnd, rows = random.Random(9), []
    for job in range(4):
        for _ in range(200):
            rows.append((job, rnd.choice("AB"), rnd.choice([True, False, None]), rnd.choice([0.5, 1.0, 2.0, None]), 0.25, float(rnd.choice([rnd.randint(-7, 20) * 50, rnd.uniform(-300, 1000)])), float(rnd.randint(0, 40) * 25)))
    rows += [(4, "A", True, 1.0, 0.5, 100.0, 100.0)] * 3  # a single place, on a corner of all widths
    rows += [(0, "A", True, 1.0, 0.5, None, 1.0), (0, "A", True, 1.0, 0.5, float("nan"), 1.0)]
    return rows, spark.createDataFrame(rows, "job int, object_type string, b_present boolean, area double, overlap_area double, x double, y double")


def test_pyramid_equals_grids_of_each_width(scattered):
    rows, objects = scattered
    widths = (50, 100, 75, 300)
    got = pyramid.grid_pyramid(objects, widths).collect()
    placed = objects.where("x is not null and not isnan(x)")
    for width in widths:
        layers = {"n_a": F.count_if(F.col("object_type") == "A"), "n_all": F.count("*"), "n_positive": F.count_if((F.col("object_type") == "A") & F.col("b_present"))}
        plain = {(r.job, r.ix, r.iy): (r.n_a, r.n_all, r.n_positive) for r in grid.cells(placed, float(width), layers, "closed").collect() if r.n_all}
        assert {(r.job, r.ix, r.iy): (r.n_a, r.n_all, r.n_positive) for r in got if r.width == width} == plain


def test_pyramid_reads_the_table_once(spark, scattered, tmp_path):
    scattered[1].write.parquet(f"{tmp_path}/objects")
    read = spark.read.parquet(f"{tmp_path}/objects")
    meta = read.select("job").distinct().limit(10).collect()
    for made in (pyramid.grid_pyramid(read, (50, 100, 300)), pyramid.section_payload(read, spark.createDataFrame(meta, "job int"), (100, 300), 50)):
        made.collect()
        final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("Scan parquet") == 1


def test_section_payload(spark, scattered):
    rows, objects = scattered
    meta = spark.createDataFrame([(j, f"animal{j}", j * 2) for j in range(5)], "job int, animal string, place int")
    reviews = spark.createDataFrame([(0, True, [1.0, 2.0], "x"), (1, False, [3.0, 4.0], "y"), (2, None, [5.0, 6.0], "y")], "job int, ready boolean, center array<double>, orientation string").withColumn("polygon", F.array("center"))
    got = {r.job: json.loads(r.json, parse_constant=lambda c: pytest.fail(c)) for r in pyramid.section_payload(objects, meta, (100, 300), 50, reviews).collect()}
    assert len(got) == 5
    for job, section in got.items():
        mine = [r for r in rows if r[0] == job and r[5] is not None and r[5] == r[5]]
        assert section["animal"] == f"animal{job}" and section["ready"] is (job == 0)
        assert section["reviewed_center"] == ([1.0, 2.0] if job == 0 else None) and section["reviewed_orientation"] == ("x" if job == 0 else None)
        assert sorted(section["grids"]) == ["100", "300"] and "n_all" not in section["fine"] and section["fine"]["width"] == 50
        for g in (section["fine"], *section["grids"].values()):
            assert np.array(g["n_a"]).shape == (len(g["y"]), len(g["x"]))
            assert np.sum(g["n_a"]) == sum(r[1] == "A" for r in mine) and np.sum(g["n_positive"]) == sum(r[1] == "A" and bool(r[2]) for r in mine)
        for g in section["grids"].values():
            assert np.sum(g["n_all"]) == len(mine) and np.sum(g["area_a"]) == pytest.approx(sum(r[3] or 0 for r in mine if r[1] == "A"))
            k = mine[0]
            iy, ix = (min(int((v - (c[0] - g["width"] / 2)) // g["width"]), len(c) - 1) for v, c in ((k[6], g["y"]), (k[5], g["x"])))
            assert g["n_all"][iy][ix] > 0
    with pytest.raises(Exception, match="without objects"):
        pyramid.section_payload(objects, meta.unionByName(spark.createDataFrame([(9, "none", 1)], meta.schema)), (100,), 50).collect()
    with pytest.raises(Exception, match="not negative"):
        pyramid.section_payload(objects.withColumn("area", F.lit(-1.0)), meta, (100,), 50).collect()
    with pytest.raises(Exception, match="cells: more than"):
        pyramid.section_payload(objects.withColumn("x", F.col("x") * 1e6), meta, (100,), 50).collect()


# --- boundary distances -------------------------------------------------------------


def test_nearest_distances():
    rng = np.random.default_rng(3)
    for trial in range(40):
        grid_like = lambda n, off: np.unique(np.column_stack([rng.integers(0, 30, n) * 2.5 + off, rng.integers(-20, 9, n) * 2.5 - off]), axis=0)  # noqa: B023, E731
        p, q = (grid_like(rng.integers(1, 80), o) for o in (0.0, rng.uniform(0, 3))) if trial % 2 else (rng.normal(0, 50, (rng.integers(1, 60), 2)) for _ in range(2))
        plain = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min(axis=1)
        assert np.allclose(geometry.nearest_distances(p, q), plain, rtol=0, atol=1e-9)


def test_nearest_distances_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    p, q = rng.integers(0, 40, (300, 2)) * 1.0, rng.integers(20, 90, (200, 2)) * 1.0
    whole = geometry.nearest_distances(p, q)
    monkeypatch.setattr(geometry, "TABLE", 100)
    assert (geometry.nearest_distances(p, q) == whole).all()


def test_long_boundaries_take_seconds():
    """Two boundaries of 100,000 cells each, wound over a grid."""
    import time

    t = np.arange(100_000)
    p = np.unique(np.column_stack([t % 1400, 10 * (t // 1400) + (t % 7)]).astype(float), axis=0)
    began = time.perf_counter()
    d = geometry.nearest_distances(p, p[:, ::-1] + 0.25)
    assert time.perf_counter() - began < 30 and len(d) > 90_000
    some = np.random.default_rng(0).choice(len(p), 50, replace=False)
    other = p[:, ::-1] + 0.25
    assert np.allclose(d[some], [np.sqrt(((other - p[i]) ** 2).sum(axis=1)).min() for i in some])


def test_flip_scores_equal_plain(spark):
    rng = np.random.default_rng(8)
    mine = {j: np.unique(rng.integers(-15, 15, (60, 2)) + 0.5 * j, axis=0) for j in (1, 2)}
    theirs = np.unique(rng.integers(-15, 15, (80, 2)) * 1.0, axis=0)
    edges = spark.createDataFrame([(j, float(x), float(y)) for j, p in mine.items() for x, y in [*p, p[0]]], "job int, x double, y double")
    got = {(r.job, r.orientation): r for r in geometry.flip_scores(edges, spark.createDataFrame(theirs.tolist(), "x double, y double")).collect()}
    for j, p in mine.items():
        for name, sign in (("none", (1, 1)), ("x", (-1, 1)), ("y", (1, -1)), ("both", (-1, -1))):
            d = np.sqrt(((p * sign)[:, None] - theirs[None]) ** 2 @ np.ones(2))
            ways = [d.min(axis=1), d.min(axis=0)]
            score = np.mean([np.sort(w)[: math.ceil(0.8 * len(w))].mean() for w in ways])
            assert got[j, name].score == pytest.approx(score) and got[j, name].tail == pytest.approx(max(np.percentile(w, 90) for w in ways))
    assert geometry.flip_scores(edges.limit(0), edges.select("x", "y")).count() == 0 and geometry.flip_scores(edges, edges.select("x", "y").limit(0)).count() == 0
