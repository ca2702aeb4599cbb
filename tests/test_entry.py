"""The driver's contract: names, columns, and values against the SQL on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for table in ("lineitem", "events"):
        path = f"{SF}/{table}.parquet"
        c.sql(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def norm(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def test_entry(spark):
    got = {r.arm: r.difference for r in entry.entry(spark).collect()}
    assert got["arm1"] == pytest.approx(5.114368, abs=1e-6) and got["arm2"] == pytest.approx(0.788049, abs=1e-6)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    rel = sql.sql(plans.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    key = lambda r: str(r)
    mine = sorted((tuple(norm(r[c]) for c in rel.columns) for r in rows), key=key)
    theirs = sorted((tuple(map(norm, r)) for r in rel.fetchall()), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_kmeans_fit_covers_every_arm_with_the_whole_sample(spark, monkeypatch):
    caps, sample = [], plans.cluster.balanced_sample
    monkeypatch.setattr(plans.cluster, "balanced_sample", lambda valid, cap, *more: (caps.append(cap), sample(valid, cap, *more))[1])
    rows = plans.QUERIES["kmeans_fit"](spark, SF).collect()
    assert sorted((r.arm, r["cluster"]) for r in rows) == [(arm, k) for arm in ("arm1", "arm2") for k in (1, 2, 3)]
    assert caps == [3000, 3000]


def test_workers_without_the_package(tmp_path):
    """Python workers that cannot import the package, as on executors that hold only the libraries, run its functions."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    script = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("clearance", "alignment_proposals"):
    print("rows", __spark_entry__.queries()[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("rows ") == 2
