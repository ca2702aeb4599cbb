"""Strict loading, provenance, repeat runs and sinks."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import summary


def write(path, rows, header=None):
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(header or [h for h, _ in sources.COLUMNS])
        out.writerows(rows)
    return str(path)


def rows(n, shift=0, **change):
    out = []
    for i in range(n):
        r = {"image_location": "C:\\img", "region": "r", "algorithm": "alg", "object_id": i + shift, "object_type": "Alpha" if i % 2 == 0 else "Beta", "overlap_area": 0, "overlap_pct": 0, "area": 1 + i, "inner_area": 1, "outer_area": i, "intensity": 0.1, "min_diameter": 1, "max_diameter": 2, "median_diameter": 1.5, "a_present": 1, "b_present": 0, "xmin": 10 + 3 * i, "xmax": 11 + 3 * i, "ymin": 10, "ymax": 12}
        r |= change if i == 0 else {}
        out.append([r[n] for _, n in sources.COLUMNS])
    return out


LABELS = {"Alpha": "A", "Beta": "B"}


def test_load(spark, tmp_path):
    got = sources.read_export(spark, write(tmp_path / "job1x.csv", rows(4)), "1", LABELS)
    assert sources.check_rows(got, expected=4) == {"rows": 4, "contiguous_ids": True}
    typed = sources.typed(got)
    r = typed.orderBy("object_id").first()
    assert (r.x, r.y, r.object_type, r.a_present) == (10.5, 11.0, "A", True) and dict(typed.dtypes)["object_id"] == "bigint"
    assert not sources.check_rows(sources.read_export(spark, write(tmp_path / "job2x.csv", rows(4, 50)), "2", LABELS))["contiguous_ids"]


@pytest.mark.parametrize("change", [{"a_present": 2}, {"object_id": 0.5}, {"object_id": -1}, {"object_type": "Gamma"}, {"area": ""}, {"area": "NaN"}, {"region": "other"}, {"region": " "}, {"object_id": 1}])
def test_bad_rows(spark, tmp_path, change):
    got = sources.read_export(spark, write(tmp_path / "f.csv", rows(4, **change)), "1", LABELS)
    with pytest.raises(ValueError):
        sources.check_rows(got)


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read_export(spark, write(tmp_path / "a.csv", rows(2), [h for h, _ in sources.COLUMNS][::-1]), "1", LABELS)
    with pytest.raises(Exception):  # noqa: B017  malformed number: Spark's own error
        sources.read_export(spark, write(tmp_path / "b.csv", rows(2, area="x")), "1", LABELS).collect()
    with pytest.raises(ValueError):
        sources.check_rows(sources.read_export(spark, write(tmp_path / "c.csv", rows(2)), "1", LABELS), expected=3)


def test_replacements():
    r = lambda job, n, g="g": {"job": job, "duplicate_group": g, "rows": n}
    status = {x["job"]: x["duplicate_status"] for x in sources.discover([r("1", 2), r("2", 4), r("3", 5, "h")], {"1": "2"})}
    assert status == {"1": "interrupted_superseded", "2": "primary_replacement", "3": "primary"}
    for bad, how in (([r("1", 2)], {"1": "2"}), ([r("1", 2), r("2", 2)], {"1": "2"}), ([r("1", 2), r("2", 4, "h")], {"1": "2"}), ([r("1", 2), r("2", 4)], {}), ([r("1", 2), r("1", 2)], {})):
        with pytest.raises(ValueError):
            sources.discover(bad, how)


def test_directory(spark, tmp_path):
    write(tmp_path / "a job1 left+1.csv", rows(2))
    write(tmp_path / "b job2 left+1.csv", rows(4))
    found = sources.discover_directory(spark, str(tmp_path), replacements={"1": "2"})
    assert [(r["job"], r["rows"], r["duplicate_status"]) for r in found] == [("1", 2, "interrupted_superseded"), ("2", 4, "primary_replacement")]
    assert found[0]["sha256"] == sources.sha256_of(tmp_path / "a job1 left+1.csv")
    objects, manifest = sources.load_dataset(spark, found, LABELS)
    assert objects.count() == 4 and manifest.count() == 2
    # Each export's counters stand beside it, those of the superseded one too.
    plain = {r.job: r.asDict() for r in summary.quality_control(sources.typed(sources.read_exports(spark, {x["path"]: x["job"] for x in found}, LABELS))).drop("n_objects").collect()}
    counted = {r.job: r.asDict() for r in manifest.collect()}
    assert set(plain) == {"1", "2"} and all(counted[j][c] == v for j, row in plain.items() for c, v in row.items()) and counted["2"]["formula_mismatch"] == 0 and counted["2"]["rows"] == 4
    hashes = sources.file_hashes(spark, f"{tmp_path}/*.csv")
    assert sources.identical_files(hashes, hashes).where("identical").count() == 2
    write(tmp_path / "odd.csv", rows(1))
    with pytest.raises(ValueError):
        sources.discover_directory(spark, str(tmp_path))


def test_modes_and_paths(spark):
    df = spark.createDataFrame([("box", r"C:\\a//B"), ("box", r"c:\A\b")], "roi_mode string, p string")
    sources.single_mode(df)
    with pytest.raises(ValueError):
        sources.single_mode(df.unionByName(df.withColumn("roi_mode", F.lit("outline"))))
    assert df.select(sources.normal_path("p")).distinct().count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2.0), (2, None, 3.0)], "job int, v double, tx double").withColumn("ty", F.col("tx"))
    assert [json.loads(r.json) for r in sources.payload(df.select("job", "v")).orderBy("json").collect()] == [{"job": 1, "v": None}, {"job": 2, "v": None}]
    with pytest.raises(ValueError):
        sources.grid_payload(df.select(F.lit(-1).alias("n_a"), F.lit(0).alias("n_b")))
    sources.write_objects(df, f"{tmp_path}/o", spark.createDataFrame([(1, True), (2, False)], "job int, ready boolean"))
    back = {r.job: r.tx for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert back == {1: 2.0, 2: None}
    sources.write_tables({"t": df.select("job")}, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/t", header=True).count() == 2
    one, two = sources.write_protocol({"b": 1, "a": 2}, str(tmp_path)), sources.write_protocol({"a": 2, "b": 1}, str(tmp_path))
    assert one == two and json.load(open(one)) == {"a": 2, "b": 1}


def test_reviews(spark, tmp_path):
    meta = spark.createDataFrame([("1", 1, "arm1", "control"), ("2", 2, "arm1", "control")], "job string, animal int, arm string, grp string")
    records = sources.default_reviews(meta)
    data = [json.loads(r.json) for r in sources.payload(records).collect()]
    (tmp_path / "r.json").write_text(json.dumps(data))
    assert sources.read_reviews(spark, str(tmp_path / "r.json"), meta, records.schema).count() == 2
    for bad in (data[:1], [{**data[0], "arm": "arm2"}, data[1]]):
        (tmp_path / "r.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            sources.read_reviews(spark, str(tmp_path / "r.json"), meta, records.schema)


def test_probe(spark, tmp_path):
    name = "img_7 job12PLA.csv"
    patterns = {"job": r"job(?P<job>\d+)", "image": r"(?P<image>img_\d+)", "region": r"(?P<animal>\d+)_(?:X-(?P<kind_a>\w)|(?P<kind_b>\w)-X)"}
    path = write(tmp_path / name, rows(2, image_location="C:\\d\\img_7.tif", region="9_Q-X"))
    got = sources.probe(spark, path, **patterns)
    assert (got["job"], got["image"], got["animal"], got["kind"], got["region"]) == ("12", "img_7", "9", "Q", "9_Q-X")
    assert sources.probe(spark, write(tmp_path / name, rows(2, image_location="C:/d/img_7.tif", region="9_X-Q")), **patterns)["kind"] == "Q"
    for bad in ({"region": "9_Q-X tail", "image_location": "img_7"}, {"region": "9_Q-X", "image_location": "img_8"}, {"region": "9_Q-X", "image_location": "none"}):
        with pytest.raises(ValueError):
            sources.probe(spark, write(tmp_path / name, rows(2, **bad)), **patterns)
    with pytest.raises(ValueError):
        sources.probe(spark, write(tmp_path / name, []), **patterns)


def test_manifest(spark, tmp_path):
    def export(name, n, **same):
        body = rows(n)
        at = [c for _, c in sources.COLUMNS]
        for r in body:
            for k, v in same.items():
                r[at.index(k)] = v
        return write(tmp_path / name, body)

    export("one.csv", 2, region="left")
    export("two+b.csv", 3, region="left tight", image_location="c:/IMG")
    entry = lambda job, file, mode, region, n: {"job": job, "file": file, "mode": mode, "pair": "left", "region": region, "rows": n}
    entries = [entry("1", "one.csv", "box", "left", 2), entry("2", "two+b.csv", "outline", "left tight", 3)]
    sizes = {m: sources.load_manifest(spark, str(tmp_path), entries, LABELS, m)[0].count() for m in ("box", "outline", "all")}
    assert sizes == {"box": 2, "outline": 3, "all": 5}
    objects, manifest = sources.load_manifest(spark, str(tmp_path), entries, LABELS, "all")
    assert {(r.job, r.roi_mode, r.pair_id) for r in objects.collect()} == {("1", "box", "left"), ("2", "outline", "left")} and manifest.count() == 2
    with pytest.raises(ValueError):
        sources.single_mode(objects)
    good = {**entries[0], "sha256": sources.sha256_of(tmp_path / "one.csv")}
    assert sources.load_manifest(spark, str(tmp_path), [good, entries[1]], LABELS)[0].count() == 2
    for change in ({"rows": 3}, {"region": "right"}, {"sha256": "0" * 64}):
        with pytest.raises(ValueError):
            sources.load_manifest(spark, str(tmp_path), [{**good, **change}, entries[1]], LABELS)
    with pytest.raises(FileNotFoundError):
        sources.load_manifest(spark, str(tmp_path), [*entries, entry("3", "absent.csv", "box", "x", 1)], LABELS)
    with pytest.raises(ValueError, match="unknown files"):
        sources.load_manifest(spark, str(tmp_path), entries[:1], LABELS)
    with pytest.raises(ValueError):
        sources.load_manifest(spark, str(tmp_path), entries, LABELS, "tight")
    export("two+b.csv", 3, region="left tight", image_location="d:/other")
    with pytest.raises(ValueError, match="exports differ"):
        sources.load_manifest(spark, str(tmp_path), entries, LABELS, "all")


def test_landmarks_and_metadata(spark, tmp_path):
    meta = spark.createDataFrame([("1", 1, "arm1", "aa"), ("2", 2, "arm1", "bb")], "job string, animal int, arm string, sha256 string")
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    data = [{"job": "1", "animal": 1, "arm": "arm1", "sha256": "aa", "polygon": square, "cue": [1, 5]}, {"job": "2", "animal": 2, "arm": "arm1", "sha256": "bb", "polygon": square}]
    file = tmp_path / "marks.json"
    file.write_text(json.dumps(data))
    assert sorted(map(tuple, sources.read_landmarks(spark, str(file), meta).collect())) == [("1", 1.0, 1.0, 4.0), ("2", 1.0, 1.0, None)]
    for bad in (data[:1], [{**data[0], "sha256": "cc"}, data[1]], [*data, data[0]], [{**data[0], "polygon": [[0, 0], [1, 1], [2, 2]]}, data[1]]):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            sources.read_landmarks(spark, str(file), meta).collect()
    path = sources.write_run_metadata(str(tmp_path / "out"), {"width": 1000}, spark.createDataFrame([("1", "/home/x/a.csv")], "job string, path string"))
    found = json.load(open(path))
    assert found["input_manifest"] == [{"job": "1", "path": "a.csv"}] and found["packages"]["numpy"] and found["parameters"] == {"width": 1000}
    sources.write_grids(spark.createDataFrame([(1, 0, 0, 5)], "job int, ix int, iy int, n int"), f"{tmp_path}/grids")
    assert spark.read.parquet(f"{tmp_path}/grids").count() == 1


def jobs_of(spark, name, work):
    """How many Spark jobs some work starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_first_lines_of_all_files_take_no_job_each(spark, tmp_path):
    patterns = {"job": r"job(?P<job>\d+)", "image": r"(?P<image>img_\d+)", "region": r"(?P<animal>\d+)_(?:X-(?P<kind_a>\w)|(?P<kind_b>\w)-X)"}
    paths = [write(tmp_path / f"img_{i} job{i} a+b%20.csv", rows(2, image_location=f"C:\\d\\img_{i}.tif", region=f"{i}_{'Q-X' if i % 2 else 'X-R'}")) for i in range(12)]
    counts = []
    for n in (2, 12):
        got, jobs = jobs_of(spark, f"probe {n}", lambda n=n: {r.job: r for r in sources.probes(spark, paths[:n], **patterns).collect()})
        counts.append(jobs)
        assert {k: (r.image, r.animal, r.kind, r.faults) for k, r in got.items()} == {str(i): (f"img_{i}", str(i), "Q" if i % 2 else "R", "") for i in range(n)}
    assert counts[0] == counts[1] <= 2
    loads = [jobs_of(spark, f"load {n}", lambda n=n: sources.read_exports(spark, {p: str(i) for i, p in enumerate(paths[:n])}, LABELS))[1] for n in (2, 12)]
    assert loads[1] <= loads[0] + 2  # a limit looks at partitions in growing steps
    odd = {
        "header differs; unknown job": write(tmp_path / "img_1 other.csv", rows(1, image_location="img_1", region="1_Q-X"), ["x"]),
        "no rows; unknown image; unknown region": write(tmp_path / "job1 empty.csv", []),
        "unknown region": write(tmp_path / "img_1 job1.csv", rows(1, image_location="img_1", region="1_Q-X tail")),
        "name and image differ": write(tmp_path / "img_2 job2.csv", rows(1, image_location="img_3", region="1_Q-X")),
    }
    got = {r.path: r.faults for r in sources.probes(spark, list(odd.values()), **patterns).collect()}
    assert got == {path: why for why, path in odd.items()}


def test_quoted_first_record(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('\ufeffa,"b\nc"\r\n"x, y",2\r\n', encoding="utf-8")
    r = sources.first_records(spark, [str(path)]).first()
    assert (r.header, r.first) == (["a", "b\nc"], ["x, y", "2"])
    (tmp_path / "none.csv").write_bytes(b"")
    r = sources.first_records(spark, [f"file://{tmp_path}/none.csv"]).first()
    assert (r.header, r.first) == (None, None) and sources.header_of(spark, str(tmp_path / "none.csv")) == []


def test_digest_of_a_file_beyond_one_value(spark, tmp_path):
    """A sparse file of more than 2 GiB, beside a small one with signs in its name."""
    import hashlib

    size, block = (1 << 31) + 12345, bytes(1 << 20)
    with open(tmp_path / "large.csv", "wb") as file:
        file.truncate(size)
    (tmp_path / "a +%41 é.csv").write_bytes(b"abc")
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(block)
    digest.update(bytes(size & ((1 << 20) - 1)))
    got = {r.name: (r.bytes, r.sha256) for r in sources.file_hashes(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {"large.csv": (size, digest.hexdigest()), "a +%41 é.csv": (3, hashlib.sha256(b"abc").hexdigest())}
    (tmp_path / "large.csv").unlink()
