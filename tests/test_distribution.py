"""Exact quantiles and top shares of many columns by brackets, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import distribution


def plain_quantile(values, p):
    v, at = sorted(values), (len(values) - 1) * p
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (at - math.floor(at)) * (hi - lo)


def plain_share(values, share):
    v = sorted(values, reverse=True)
    return 100 * sum(v[: max(1, math.ceil(share * len(v)))]) / sum(v) if sum(v) > 0 else None


@pytest.mark.parametrize("whole", [1000, 10_000])
def test_selected(spark, monkeypatch, whole):
    """Groups within and beyond WHOLE; values repeated by a third of a group, all equal, negative, unknown; unknown keys."""
    monkeypatch.setattr(distribution, "WHOLE", whole)
    rnd = random.Random(2)
    values = {"many": [rnd.gauss(0, 1) for _ in range(6000)], "tied": [5.0] * 2000 + [rnd.uniform(0, 10) for _ in range(4000)], "equal": [1.0] * 3000, "steps": [float(rnd.randint(0, 5)) for _ in range(5000)], "few": [3.0, -1.0, 8.0], "none": [None] * 5}
    rows = [(k, v, None if v is None else 2 * v + 1) for k, vs in values.items() for v in vs] + [("few", None, 4.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, a double, b double")
    wanted = {"a0": ("a", 0.0), "a1": ("a", 0.25), "a2": ("a", 0.5), "a3": ("a", 0.999), "a4": ("a", 1.0), "b2": ("b", 0.5)}
    got = {r.k: r for r in distribution.selected(frame, wanted, {"top": ("b", 0.01), "half": ("b", 0.5), "all": ("b", 1.0)}, ["k"], [F.count("*").alias("n")]).collect()}
    assert set(got) == set(values)
    for k, r in got.items():
        assert r.n == sum(x[0] == k for x in rows)
        known = {c: [x[i] for x in rows if x[0] == k and x[i] is not None] for i, c in ((1, "a"), (2, "b"))}
        for name, (c, p) in wanted.items():
            assert r[name] == (pytest.approx(plain_quantile(known[c], p)) if known[c] else None)
        for name, share in (("top", 0.01), ("half", 0.5), ("all", 1.0)):
            expected = plain_share(known["b"], share) if known["b"] else None
            assert r[name] == (None if expected is None else pytest.approx(expected))


def test_selected_of_nothing(spark):
    none = spark.createDataFrame([], "k string, a double")
    assert distribution.selected(none, {"m": ("a", 0.5)}, {"t": ("a", 0.1)}, ["k"], [F.count("*").alias("n")]).count() == 0
    assert distribution.quantile_columns(none, {"m": ("a", 0.5)}, ["k"]).count() == 0


def test_only_brackets_move(spark, monkeypatch):
    """Of 200,000 distinct values a few thousand are shuffled, and the table is read twice."""
    frame = spark.range(200_000).selectExpr("id % 2 as k", "cast(pmod(id * 7919, 200003) as double) as a", "cast(id as double) as b")
    out = distribution.selected(frame, {"m": ("a", 0.5), "q": ("b", 0.9)}, {"t": ("a", 0.01)}, ["k"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString().split("== Initial Plan ==")[0]
    assert text.count("Range (0, 200000") == 1  # the first reading was the brackets' own job
    exact = {r.k: (r.m, r.q) for r in frame.groupBy("k").agg(F.percentile("a", F.lit(0.5)).alias("m"), F.percentile("b", F.lit(0.9)).alias("q")).collect()}
    assert {r.k: (r.m, r.q) for r in out.collect()} == exact


def plain_concentration(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(((-v, i is not None, i) for g, i, v in rows if g == k and v is not None))
        total, so_far = sum(-v for v, _, _ in mine), 0.0
        for rank, (v, _, i) in enumerate(mine, 1):
            so_far -= v
            out[k, i, rank] = 100 * rank / len(mine), 100 * so_far / total if total > 0 else None
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_concentration_of_tied_values(spark, kind):
    """A value held by a third of a group, by two thirds, by all; two such values; one id that repeats; unknown ids, values and keys."""
    rnd = random.Random(6)
    groups = {"third": [5.0] * 1000 + [rnd.uniform(0, 10) for _ in range(2000)], "two": [2.0] * 900 + [7.5] * 900 + [rnd.uniform(0, 10) for _ in range(500)], "all": [1.0] * 1500, "top": [9.0] * 700 + [1.0] * 3, "few": [3.0, 3.0, 8.0], "none": [None, None]}
    number = iter(rnd.sample(range(100_000), 12_000))
    rows = [(k, next(number), v) for k, vs in groups.items() for v in vs]
    rows += [("third", None, 5.0), (None, 1, 5.0)]
    if kind == "string":
        rows = [(k, None if i is None else f"id {i}", v) for k, i, v in rows]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, f"k string, object_id {kind}, v double").repartition(5)
    got = distribution.concentration(frame, "v", ["k"]).collect()
    expected = plain_concentration(rows)
    assert len(got) == len(expected) == len({(r.k, r.object_id, r["rank"]) for r in got})
    for r in got:
        assert (r.objects_pct, r.value_pct) == pytest.approx(expected[r.k, r.object_id, r["rank"]])
    same = spark.range(3000).selectExpr("'a' as k", "7L as object_id", "1.0D as v")
    assert sorted(r["rank"] for r in distribution.concentration(same, "v", ["k"]).collect()) == list(range(1, 3001))


def test_tied_values_are_many_pieces(spark):
    """One value held by a third of 200,000 rows: no piece is much larger than a bucket."""
    frame = spark.range(200_000).selectExpr("'a' as k", "pmod(id * 7919, 200003) as object_id", "if(id % 3 = 0, 5.0D, cast(id as double)) as v")
    per, ties = distribution._ties(frame, "v", ["k"], "object_id", distribution.cut_points(frame, "v", ["k"]))
    (tie,) = ties.collect()
    ids = sorted(r.object_id for r in frame.where("v = 5").collect())
    edges = [-1, *tie._ids, 10**9]
    sizes = [sum(a < i <= b for i in ids) for a, b in zip(edges, edges[1:], strict=False)]
    assert len(sizes) >= 20 and sum(sizes) == len(ids) and max(sizes) < 2 * 200_000 / distribution.BUCKETS
    assert sum(r._c for r in per.collect()) == 200_000
    assert distribution._ties(frame.where("v <> 5"), "v", ["k"], "object_id", distribution.cut_points(frame.where("v <> 5"), "v", ["k"]))[1] is None


def test_numbered(spark, monkeypatch):
    """Places by id over pieces of a group; unknown keys and ids, repeated ids; no window holds a whole group."""
    monkeypatch.setattr(distribution, "PIECE", 256)
    ids = [f"{i * 7919 % 5000}-{i % 7}" for i in range(5000)]
    rows = [("one", i) for i in ids] + [("few", "b"), ("few", None), ("few", "a"), ("few", "a"), (None, "y"), (None, "x")]
    got = distribution.numbered(spark.createDataFrame(rows, "k string, object_id string"), "object_id", ("k",))
    assert got.columns == ["k", "object_id", "number"]
    for k in ("one", "few", None):
        mine = sorted((r.number, r.object_id) for r in got.where(F.col("k").eqNullSafe(F.lit(k))).collect())
        assert mine == list(enumerate(sorted((i for key, i in rows if key == k), key=lambda i: (i is not None, i or ""))))
    pieces = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(pieces) > 4 and max(r["count"] for r in pieces) < 2500
    empty = distribution.numbered(spark.createDataFrame([], "k string, object_id string"), "object_id", ("k",))
    assert empty.count() == 0


def test_export_checks_parts_a_section(spark, monkeypatch):
    """The rows of a section are numbered by many tasks, with the same report."""
    from tessella.plans import study_queries  # noqa: F401  registers its queries
    from tessella.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    whole = sorted(map(str, QUERIES["export_checks"](spark, sf).collect()))
    pieces, made = [], distribution.numbered
    monkeypatch.setattr(distribution, "PIECE", 64)
    monkeypatch.setattr(distribution, "numbered", lambda *a, **k: pieces.append(made(*a, **k)) or pieces[-1])
    assert sorted(map(str, QUERIES["export_checks"](spark, sf).collect())) == whole
    assert pieces[0].rdd.getNumPartitions() > 2 * len(whole)
