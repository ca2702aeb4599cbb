"""Strict scans of fixed-schema exports, with provenance and a policy for repeated runs.

Files are read with an explicit schema; a header that differs, a malformed
number or an unknown label is an error, never a NULL.  Checks run as one
aggregate per load.
"""

import csv
import hashlib
import importlib.metadata
import io
import json
import os
import platform
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import midpoint, polygon_centroid, reasons
from ..operators.summary import quality_control

# Column order of an export (header, name); None is dropped after the checks.
COLUMNS = (
    ("Image Location", "image_location"), ("Analysis Region", "region"), ("Algorithm Name", "algorithm"), ("Object Id", "object_id"), ("Object Type", "object_type"),
    ("Overlap Area", "overlap_area"), ("Overlap %", "overlap_pct"), ("Area (µm²)", "area"), ("Inner Area (µm²)", "inner_area"), ("Outer Area (µm²)", "outer_area"), ("Average Intensity", "intensity"),
    ("Minimum Diameter (µm)", "min_diameter"), ("Maximum Diameter (µm)", "max_diameter"), ("Median Diameter (µm)", "median_diameter"), ("A Present", "a_present"), ("B Present", "b_present"),
    ("XMin", "xmin"), ("XMax", "xmax"), ("YMin", "ymin"), ("YMax", "ymax"),
)
TEXT = ("image_location", "region", "algorithm", "object_type")
NUMBERS = tuple(n for _, n in COLUMNS if n not in TEXT)


def export_schema(columns=COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType() if n in TEXT else T.DoubleType()) for h, n in columns])


def header_of(spark: SparkSession, path: str) -> list:
    """The first line's fields, without a byte-order mark."""
    return list(first_records(spark, [path]).first()["header"] or [])


def read_exports(spark: SparkSession, jobs: dict, labels: dict, columns=COLUMNS) -> DataFrame:
    """Exports as one scan of typed rows, ``jobs``: path -> job; ``labels`` maps the files' class labels to ours.  Headers and their order must match."""
    paths, expected = list(jobs), F.array(*(F.lit(h) for h, _ in columns))
    if odd := _listed(first_records(spark, paths).where(~F.col("header").eqNullSafe(expected)).select("path")):
        raise ValueError(f"{', '.join(sorted(r['path'] for r in odd))}: header differs")
    raw = spark.read.schema(export_schema(columns)).csv(paths, header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8")
    name = _file_name(F.col("_metadata.file_path"))
    lookup = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    job = F.lit(next(iter(jobs.values()))) if len(jobs) == 1 else F.element_at(lookup({os.path.basename(p): j for p, j in jobs.items()}), name)
    rows = raw.select(*(F.col(f"`{h}`").alias(n) for h, n in columns), job.alias("job"))
    return rows.withColumn("object_type", F.coalesce(F.element_at(lookup(labels), F.col("object_type")), F.concat(F.lit("?"), "object_type")))


def read_export(spark: SparkSession, path: str, job: str, labels: dict, columns=COLUMNS) -> DataFrame:
    """One export as typed rows."""
    return read_exports(spark, {path: job}, labels, columns)


def row_faults(rows: DataFrame, classes=("A", "B"), keys=("job",)) -> DataFrame:
    """All row checks of every export in one aggregate: counts of what is wrong, rows, and whether ids are contiguous."""
    number = [n for n in NUMBERS if n in rows.columns]
    odd = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    i = F.col("object_id")
    constant = [c for c in ("region", "image_location", "algorithm") if c in rows.columns]
    flags = F.greatest(*(~F.col(c).cast("int").isin(0, 1) for c in ("a_present", "b_present")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.greatest(*map(odd, number))).alias("unknown_numbers"),
        F.count_if((i < 0) | (i >= 2.0**53) | (i != F.floor(i))).alias("bad_ids"),
        (F.count("*") - F.countDistinct("object_id")).alias("repeated_ids"),
        F.count_if(flags).alias("odd_flags"),
        F.count_if(~F.coalesce(F.col("object_type").isin(*classes), F.lit(False))).alias("unknown_classes"),
        *(F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"blank_{c}") for c in constant),
        *((F.countDistinct(c) - 1).alias(f"more_{c}") for c in constant),
        *(F.min(c).alias(f"first_{c}") for c in constant),
        ((F.min("object_id") == 0) & (F.max("object_id") == F.count("*") - 1) & (F.countDistinct("object_id") == F.count("*"))).alias("contiguous_ids"),
    )


def check_rows(rows: DataFrame, classes=("A", "B"), expected: int | None = None) -> dict:
    """Raise with the counts of what is wrong in one export; gives its row count and whether its ids are contiguous."""
    got = row_faults(rows, classes, ()).first().asDict()
    _raise_faults(got, expected)
    return {"rows": got["n"], "contiguous_ids": got["contiguous_ids"]}


def _raise_faults(got: dict, expected: int | None, of: str = "") -> None:
    counts = {k: v for k, v in got.items() if not isinstance(v, bool) and isinstance(v, int) and k not in ("n", "job")}
    faults = [f"{v} {k.replace('_', ' ')}" for k, v in counts.items() if v > 0]
    if not got["n"]:
        faults.append("no rows")
    if expected is not None and got["n"] != expected:
        faults.append(f"{got['n']} rows, {expected} recorded")
    if faults:
        raise ValueError(of + "; ".join(faults))


def cross_file_faults(found: list) -> list:
    """What exports of one study may not differ in: the image, after normalising its path, and the algorithm.  ``found``: rows of :func:`row_faults`."""
    images = {re.sub(r"[\\/]+", "/", r["first_image_location"]).lower() for r in found}
    algorithms = {r["first_algorithm"] for r in found}
    return [f"{len(x)} {name}" for name, x in (("images", images), ("algorithms", algorithms)) if len(x) > 1]


def typed(rows: DataFrame) -> DataFrame:
    """Checked rows as objects: ids as integers, flags as booleans, midpoints added, metadata columns dropped."""
    out = rows.withColumn("object_id", F.col("object_id").cast("long"))
    for c in ("a_present", "b_present"):
        out = out.withColumn(c, F.col(c) == 1)
    return out.withColumn("x", midpoint("xmin", "xmax")).withColumn("y", midpoint("ymin", "ymax")).drop("image_location", "algorithm")


def _file_name(path):
    """The name of a file in its URI."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


#: Stores whose files tasks can open themselves, by scheme; files of others are read whole by Spark.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs")
BLOCK = 1 << 20


def _opened(path: str):
    """A stream of a file, in the task that reads it; a path is taken literally, as Spark does."""
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem().open_input_stream(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    host, _, at = rest.lstrip("/").partition("/")
    store, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return store.open_input_stream(f"{base.rstrip('/')}/{at}")


def _paths(spark: SparkSession, paths: list) -> DataFrame:
    """One row per path, dealt over as many tasks as there are paths, within reason."""
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)), "path")


def first_records(spark: SparkSession, paths: list) -> DataFrame:
    """``(path, header, first)``: the first two CSV records of every file, null where there is none; one pass over all files that reads a block of each.

    Files are UTF-8, with or without a byte-order mark.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with _opened(path) as stream, io.TextIOWrapper(stream, encoding="utf-8-sig", newline="") as text:
                    records = csv.reader(text)
                    rows.append((path, next(records, None), next(records, None)))
            yield pd.DataFrame(rows, columns=["path", "header", "first"])

    return _paths(spark, list(paths)).mapInPandas(run, "path string, header array<string>, first array<string>")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes, sha256)`` of files.

    Files are listed by Spark and hashed in tasks, a block of BLOCK bytes at a
    time, whatever their size.  Those of a store that tasks cannot open are one
    value each, of 2 GiB at most.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    if any(c not in OPENED for c in {r["path"].split(":", 1)[0] for r in _listed(listed)}):
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for pdf in batches:
            rows = []
            for at in pdf["path"]:
                digest = hashlib.sha256()
                with _opened(at) as stream:
                    while part := stream.read(BLOCK):
                        digest.update(part)
                rows.append(digest.hexdigest())
            yield pdf.assign(sha256=rows)[["name", "bytes", "sha256"]]

    return listed.repartition("path").mapInPandas(run, "name string, bytes long, sha256 string")


def identical_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of one name on both sides, and whether their bytes agree."""
    return a.select("name", F.col("sha256").alias("a")).join(b.select("name", F.col("sha256").alias("b")), "name").select("name", (F.col("a") == F.col("b")).alias("identical"))


def sha256_of(path: str, block: int = 1 << 20) -> str:
    """Digest of a local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while part := file.read(block):
            digest.update(part)
    return digest.hexdigest()


def normal_path(c):
    """Windows path, lower-cased, with single separators."""
    return F.lower(F.regexp_replace(c, r"[\\/]+", r"\\"))


def discover(records: list, replacements: dict) -> list:
    """Status of each export: ``primary``, ``interrupted_superseded`` or ``primary_replacement``.

    ``records``: dicts with ``job``, ``duplicate_group`` and ``rows``;
    ``replacements``: superseded job -> its replacement, as reviewed.  A
    superseded job needs its replacement, of the same group and with more rows;
    any other repeat of a group is an error.
    """
    by = {r["job"]: r for r in records}
    if len(by) != len(records):
        raise ValueError("repeated job")
    for old, new in replacements.items():
        if old in by:
            if new not in by:
                raise ValueError(f"{old} requires replacement {new}")
            if by[old]["duplicate_group"] != by[new]["duplicate_group"]:
                raise ValueError(f"{new} is of another group than {old}")
            if by[new]["rows"] <= by[old]["rows"]:
                raise ValueError(f"{new} has no more rows than {old}")
    out, seen = [], set()
    for r in sorted(records, key=lambda r: r["job"]):
        status = "interrupted_superseded" if r["job"] in replacements else "primary_replacement" if r["job"] in replacements.values() and any(o in by for o, n in replacements.items() if n == r["job"]) else "primary"
        if status != "interrupted_superseded":
            if r["duplicate_group"] in seen:
                raise ValueError(f"Unreviewed repeated group {r['duplicate_group']}")
            seen.add(r["duplicate_group"])
        out.append({**r, "duplicate_status": status})
    return out


#: Exports of a study.
MAX_EXPORTS = 10_000


def _listed(rows: DataFrame) -> list:
    got = rows.limit(MAX_EXPORTS + 1).collect()
    if len(got) > MAX_EXPORTS:
        raise ValueError(f"more than {MAX_EXPORTS} exports")
    return got


def probes(spark: SparkSession, paths: list, job: str, image: str, region: str, columns=COLUMNS) -> DataFrame:
    """What headers, first records and names of exports say of them, one row each, from one pass over all.

    ``job`` is searched in the file's name, ``image`` in the base name of its
    image, ``region`` must match the region wholly.  Named groups of the three
    are columns (of alternatives, named ``key_a`` and ``key_b``, the one that
    matched is ``key``).  ``faults`` says what is wrong, and is empty otherwise.
    """
    place = {h: i for i, (h, _) in enumerate(columns)}
    rows = first_records(spark, paths).withColumn("source_file", F.element_at(F.split("path", "/"), -1))
    for (header, _), name in zip(columns[:3], ("image_location", "region", "algorithm"), strict=True):
        rows = rows.withColumn(name, F.coalesce(F.get("first", F.lit(place[header])), F.lit("")))
    looked = ((job, F.col("source_file")), (image, F.element_at(F.split("image_location", r"[\\/]"), -1)), (rf"\A(?:{region})\z", F.col("region")))
    groups, hit = {}, []
    for pattern, text in looked:
        java = re.sub(r"\(\?P<\w+>", "(", pattern)  # by number: names need not be ones that Java takes
        hit.append(text.rlike(java))
        for key, i in re.compile(pattern.replace(r"\z", r"\Z")).groupindex.items():
            groups.setdefault(re.sub(r"_[ab]$", "", key), []).append(F.nullif(F.regexp_extract(text, java, i), F.lit("")))
    known = F.col("header").eqNullSafe(F.array(*(F.lit(h) for h, _ in columns)))
    whole = F.regexp_extract(looked[1][1], re.sub(r"\(\?P<\w+>", "(", image), 0)
    faults = {"header_differs": ~known, "no_rows": F.col("first").isNull(), "unknown_job": ~hit[0], "unknown_image": ~hit[1], "unknown_region": ~hit[2], "name_and_image_differ": hit[1] & ~F.col("source_file").startswith(whole)}
    return rows.select("path", "source_file", "image_location", "region", "algorithm", *(F.coalesce(*g).alias(k) for k, g in groups.items()), reasons(**faults).alias("faults"))


def probe(spark: SparkSession, path: str, job: str, image: str, region: str, columns=COLUMNS) -> dict:
    """The row of :func:`probes` of one export; a fault is an error."""
    got = probes(spark, [path], job, image, region, columns).first().asDict()
    if got["faults"]:
        raise ValueError(f"{path}: {got['faults']}")
    return {k: v for k, v in got.items() if k != "faults"}


def discover_directory(spark: SparkSession, root: str, pattern: str = r"job(?P<job>\d+)(?P<group>.*)\.csv$", replacements: dict | None = None, expected=None) -> list:
    """Exports of a folder: job and group from the file name; rows, bytes and digests of all files by one scan each."""
    hashes = {r["name"]: r for r in _listed(file_hashes(spark, os.path.join(root, "*.csv")))}
    if not hashes:
        raise FileNotFoundError(f"no exports in {root}")
    lines = spark.read.option("header", True).csv(os.path.join(root, "*.csv")).groupBy(F.col("_metadata.file_path").alias("path")).count()
    counts = {r["name"]: r["count"] for r in _listed(lines.select(_file_name(F.col("path")).alias("name"), "count"))}
    records = []
    for name, r in sorted(hashes.items()):
        m = re.search(pattern, name)
        if not m:
            raise ValueError(f"unknown file {name}")
        records.append({"job": m["job"], "duplicate_group": m["group"], "path": os.path.join(root, name), "rows": counts.get(name, 0), "bytes": r["bytes"], "sha256": r["sha256"]})
    if expected is not None and {r["job"] for r in records} != set(expected):
        raise ValueError("missing or unknown exports")
    return discover(records, replacements or {})


def load_dataset(spark: SparkSession, records: list, labels: dict, same_study: bool = False) -> tuple:
    """All primary exports as one frame, every export checked; with its manifest.  Two aggregates over all files: the checks, and the counters of odd rows.

    The manifest has a row for each export, superseded ones too, with its
    counters of :func:`~tessella.operators.summary.quality_control`.

    ``same_study``: all exports must agree in image and algorithm.
    """
    if not records:
        return None, None
    rows = read_exports(spark, {r["path"]: r["job"] for r in records}, labels)
    found = {r["job"]: r.asDict() for r in _listed(row_faults(rows))}
    manifest, counters = [], {}
    for r in records:
        got = found.get(r["job"], {"n": 0, "contiguous_ids": False})
        _raise_faults(got, r.get("rows"), f"{r['job']}: ")
        manifest.append({**r, "rows": got["n"], "contiguous_ids": got["contiguous_ids"]})
    if same_study and (faults := cross_file_faults(list(found.values()))):
        raise ValueError("exports differ: " + ", ".join(faults))
    for r in _listed(quality_control(typed(rows)).drop("n_objects")):
        counters[r["job"]] = r.asDict()
    manifest = [{**r, **counters[r["job"]]} for r in manifest]
    kept = [r["job"] for r in records if r["duplicate_status"] != "interrupted_superseded"]
    return typed(rows.where(F.col("job").isin(*kept))), spark.createDataFrame(manifest)


def load_manifest(spark: SparkSession, root: str, entries: list, labels: dict, mode: str = "box", verify_hashes: bool = True) -> tuple:
    """The exports of a fixed manifest in one region mode (``box``, ``outline`` or ``all``), every file and row checked.

    ``entries``: dicts with ``job``, ``file``, ``mode``, ``pair``, ``region`` and
    ``rows``, and ``sha256`` where it is recorded.  Files that are missing, or
    that no entry knows, are errors, and so is a region other than recorded.
    """
    if mode not in ("box", "outline", "all"):
        raise ValueError("mode must be box, outline or all")
    chosen = [e for e in entries if mode in ("all", e["mode"])]
    hashes = {r["name"]: r for r in _listed(file_hashes(spark, os.path.join(root, "*.csv")))} if verify_hashes else {}
    names = set(hashes) if verify_hashes else {r[0] for r in _listed(spark.read.format("binaryFile").load(os.path.join(root, "*.csv")).select(F.element_at(F.split("path", "/"), -1)))}
    if missing := sorted(e["file"] for e in chosen if e["file"] not in names):
        raise FileNotFoundError(f"missing: {missing}")
    if unknown := sorted(names - {e["file"] for e in entries}):
        raise ValueError(f"unknown files: {unknown}")
    if wrong := [e["file"] for e in chosen if verify_hashes and e.get("sha256") and hashes[e["file"]]["sha256"] != e["sha256"]]:
        raise ValueError(f"digests differ: {wrong}")
    records = [{"job": e["job"], "path": os.path.join(root, e["file"]), "rows": e["rows"], "duplicate_status": "primary", "roi_mode": e["mode"], "pair_id": e["pair"], "region": e["region"], "sha256": hashes[e["file"]]["sha256"] if verify_hashes else ""} for e in chosen]
    objects, manifest = load_dataset(spark, records, labels, same_study=True)
    regions = {r["job"]: r["region"] for r in _listed(objects.select("job", "region").distinct())}
    if wrong := [e["job"] for e in chosen if regions.get(e["job"]) != e["region"]]:
        raise ValueError(f"regions differ from the manifest: {wrong}")
    return objects.join(F.broadcast(manifest.select("job", "roi_mode", "pair_id")), "job"), manifest


def single_mode(objects: DataFrame, column: str = "roi_mode") -> None:
    """Raise if rows of two region modes would be pooled."""
    if objects.select(column).distinct().limit(2).count() > 1:
        raise ValueError("more than one region mode")


def _same_identity(records: DataFrame, metadata: DataFrame, same, what: str) -> DataFrame:
    """``records``, after checking that every section of ``metadata`` has one that agrees with it in ``same``."""
    both = records.select("job", F.struct(*same).alias("r")).join(metadata.select("job", F.struct(*same).alias("m")), "job", "full_outer")
    if not both.where(~F.col("r").eqNullSafe(F.col("m")) | F.col("r").isNull()).isEmpty() or not records.groupBy("job").count().where("count > 1").isEmpty():
        raise ValueError(f"{what} and metadata differ")
    return records


def read_reviews(spark: SparkSession, path: str, metadata: DataFrame, schema: T.StructType, same=("animal", "arm", "grp")) -> DataFrame:
    """Review records of a JSON file; jobs, identity fields and, where both sides have it, the digest of the source must agree with the metadata."""
    records = spark.read.schema(schema).option("multiLine", True).json(path)
    digest = ("sha256",) if "sha256" in records.columns and "sha256" in metadata.columns else ()
    return _same_identity(records, metadata, (*same, *digest), "review records")


def read_landmarks(spark: SparkSession, path: str, metadata: DataFrame, same=("animal", "arm", "sha256")) -> DataFrame:
    """Annotated landmarks of a JSON file: ``(job, cx, cy, cue_dy)``, the centroid of each polygon and where its cue lies above or below it.

    Records have ``job``, the fields of ``same``, ``polygon`` (a list of x, y
    pairs) and an optional ``cue`` (x, y); they must agree with the metadata, and
    every polygon must have its centroid inside.
    """
    types = dict(metadata.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("job", *same)) + ", polygon array<array<double>>, cue array<double>"
    records = _same_identity(spark.read.schema(schema).option("multiLine", True).json(path), metadata, same, "landmarks")
    points = F.transform("polygon", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rows = records.withColumn("_points", points).withColumn("_c", polygon_centroid("_points"))
    if not rows.where("_c is null").isEmpty():
        raise ValueError("a landmark is degenerate or its centroid lies outside")
    return rows.select("job", F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"), (F.get("cue", F.lit(1)) - F.col("_c.y")).alias("cue_dy"))


def default_reviews(metadata: DataFrame) -> DataFrame:
    """Blank records: nothing is reviewed."""
    no, text = F.lit(False), F.lit("")
    polygon = F.lit(None).cast("array<struct<x:double,y:double>>")
    return metadata.select("job", "animal", "arm", "grp", polygon.alias("reviewed_polygon"), no.alias("landmark_reviewed"), F.lit("none").alias("orientation"), no.alias("orientation_reviewed"), no.alias("scale_common_confirmed"), no.alias("support_reviewed"), no.alias("support_qc"), text.alias("reviewer"), text.alias("second_reviewer"))


def write_tables(tables: dict, root: str) -> None:
    """Each table as compressed CSV in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{root}/{name}")


def write_objects(objects: DataFrame, root: str, approved: DataFrame, job: str = "job") -> None:
    """Objects by section; aligned coordinates only where the section is approved (``job, ready``)."""
    status = approved.select(job, "ready")
    sections = objects.sparkSession.createDataFrame(_listed(status), status.schema)  # checked to be few
    rows = objects.join(F.broadcast(sections), job, "left")
    for c in ("tx", "ty"):
        rows = rows.withColumn(c, F.when(F.col("ready"), F.col(c)))
    rows.drop("ready").write.mode("overwrite").partitionBy(job).parquet(root)


def write_grids(grids: DataFrame, root: str, key: str = "job") -> None:
    """Grid layers by section, columnar and compressed."""
    grids.write.mode("overwrite").partitionBy(key).parquet(root)


def write_run_metadata(root: str, parameters: dict, manifest: DataFrame, packages=("pyspark", "pyarrow", "pandas", "numpy")) -> str:
    """Versions, settings and the input manifest of a run as ``run_metadata.json``, without paths of the machine."""
    versions = {}
    for name in packages:
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = "not installed"
    rows = [{k: os.path.basename(v) if k == "path" else v for k, v in r.asDict().items()} for r in _listed(manifest)]
    document = {"python": platform.python_version(), "packages": versions, "parameters": parameters, "input_manifest": rows}
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, "run_metadata.json")
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        file.write(json.dumps(document, indent=1, allow_nan=False) + "\n")
    os.replace(f"{path}.part", path)
    return path


def payload(rows: DataFrame) -> DataFrame:
    """Each row as strict JSON: numbers that are not finite become null, nulls are written."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def grid_payload(grids: DataFrame, counts=("n_a", "n_b")) -> DataFrame:
    """As :func:`payload`, after checking that counts are known, finite and not negative."""
    bad = F.greatest(*(F.coalesce((F.col(c) < 0) | F.isnan(F.col(c).cast("double")), F.lit(True)) for c in counts))
    if not grids.where(bad).isEmpty():
        raise ValueError("unknown or negative counts")
    return payload(grids)


def write_protocol(document: dict, root: str) -> str:
    """A JSON file named for its content (12 digits of its SHA-256); an equal one is left alone."""
    text = json.dumps(document, sort_keys=True, indent=1, allow_nan=False)
    path = os.path.join(root, f"protocol-{hashlib.sha256(text.encode()).hexdigest()[:12]}.json")
    os.makedirs(root, exist_ok=True)
    if not os.path.exists(path):
        with open(f"{path}.part", "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(f"{path}.part", path)
    return path
