"""Queries over the driver's tables, each an operator of the library on an objects view, with its SQL equivalent.

``lineitem`` stands in for measurement exports: sections are part keys modulo
12, replicates modulo 6, classes follow the line status.  Every query runs over
the whole table; its SQL says the same in other words.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flag, flipped, midpoint, percent
from ..operators import cluster, contrast, distribution, geometry, grid, multiset, neighbors, summary
from .design import AREA_THRESHOLDS, SIZE_EDGES

_FIELDS = """CAST(l_partkey % 12 AS INT) AS job, CAST(l_partkey % 6 AS INT) AS animal,
  CASE WHEN l_partkey % 12 < 6 THEN 'arm1' ELSE 'arm2' END AS arm,
  CASE WHEN l_partkey % 6 < 3 THEN 'control' ELSE 'treated' END AS grp,
  concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20))) AS object_id,
  CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS object_type,
  l_extendedprice / 100000.0e0 AS area, l_extendedprice / 100000.0e0 * l_discount * 10.0e0 AS overlap_area,
  l_discount * 1000.0e0 AS overlap_pct, l_discount > 0.05e0 AS b_present, l_tax > 0.04e0 AS a_present,
  l_tax * 10.0e0 AS min_diameter, l_quantity / 50.0e0 AS max_diameter, l_discount * 10.0e0 AS median_diameter,
  CASE WHEN l_linenumber = 7 THEN l_extendedprice / 400000.0e0 ELSE 0.0e0 END AS inner_area, CASE WHEN l_linenumber >= 6 THEN l_extendedprice / 200000.0e0 ELSE l_extendedprice / 100000.0e0 END AS outer_area,
  CASE WHEN l_linenumber <> 7 THEN l_quantity * l_tax END AS intensity,
  CAST(l_orderkey AS DOUBLE) - {h} AS xmin, CAST(l_orderkey AS DOUBLE) + {h} AS xmax, l_quantity * 100.0e0 - 40.0e0 AS ymin, l_quantity * 100.0e0 + 40.0e0 AS ymax,
  l_quantity, l_linenumber, l_orderkey""".replace("{h}", "CASE WHEN l_linenumber = 5 THEN 0.0e0 WHEN l_linenumber = 6 AND l_quantity <= 2 THEN -40.0e0 ELSE 40.0e0 END")
V = f"WITH RECURSIVE v AS (SELECT {_FIELDS}, CAST(l_orderkey AS DOUBLE) AS x, l_quantity * 100.0e0 AS y FROM lineitem)"
WIDTH = 1000.0
#: Fixed centroids (log area, shape) for the assignment queries.
CENTROIDS = ((-0.8, 0.2), (-0.4, 0.6), (-0.2, 2.0))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.sql(f"SELECT {_FIELDS} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return boxes.withColumn("x", midpoint("xmin", "xmax")).withColumn("y", midpoint("ymin", "ymax"))


def _spread(v: DataFrame) -> DataFrame:
    """Positions on a common square, so that grids have the same size at every scale."""
    return v.withColumn("x", F.pmod(F.col("x") * 7, F.lit(9973.0)))


_VX = f"{V}, w AS (SELECT * REPLACE ((x * 7) % 9973.0e0 AS x) FROM v)"


#: Measurements, their sums and their interpolated quantiles have 9 decimals at most, so rounding meets no tie.
DIGITS = 9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(objects(spark, sf_dir)), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN 100.0e0 * {n} / {d} END"


def _r(e: str, name: str) -> str:
    return f"round({e}, {DIGITS}) AS {name}"


A, B = "object_type = 'A'", "object_type = 'B'"
_N = lambda c: f"count(*) FILTER (WHERE {c})"

_OTHER = f"CASE WHEN {A} THEN b_present ELSE a_present END"
_ANY_ZERO, _ZERO_BOX = "(min_diameter = 0 OR median_diameter = 0 OR max_diameter = 0)", "(xmin = xmax OR ymin = ymax)"
_SHARE = lambda c, name: _r(f"100.0e0 * {_N(c)} / count(*)", name)

query("object_summary", f"""{V}, r AS (SELECT *, row_number() OVER (PARTITION BY job, object_type ORDER BY area DESC) AS k, count(*) OVER (PARTITION BY job, object_type) AS nn FROM v)
SELECT job, object_type, count(*) AS n_objects, {_N('a_present')} AS a_count, {_SHARE('a_present', 'a_pct')}, {_N('b_present')} AS b_count, {_SHARE('b_present', 'b_pct')},
 {_N(_OTHER)} AS other_count, {_SHARE(_OTHER, 'other_pct')},
 {_N('overlap_area > 0')} AS overlap_count, {_r('sum(area)', 'area_sum')}, {_r('sum(overlap_area)', 'overlap_sum')}, {_r(_pct('sum(overlap_area)', 'sum(area)'), 'weighted_overlap_pct')},
 {_r('avg(overlap_pct)', 'mean_overlap_pct')}, {_r('max(area)', 'max_area')}, {_r('max(intensity)', 'max_intensity')},
 {', '.join(f'{_N(f"{c}_diameter = 0")} AS zero_{c}_count' for c in ('min', 'median', 'max'))}, {_N(_ANY_ZERO)} AS any_zero_count, {_SHARE(_ANY_ZERO, 'any_zero_pct')}, {_N(_ZERO_BOX)} AS zero_box_count, {_SHARE(_ZERO_BOX, 'zero_box_pct')},
 {', '.join(_r(f'quantile_cont({c}, {q})', n) for n, (c, q) in summary.QUANTILES.items())},
 {_r(_pct('sum(area) FILTER (WHERE k <= greatest(1, ceil(0.01e0 * nn)))', 'sum(area)'), 'top_share_pct')}
FROM r GROUP BY job, object_type""")(summary.object_summary)

_QC_COLUMNS = ("job", "animal", "arm", "grp", "object_id", "object_type", "area", "overlap_area", "overlap_pct", "b_present", "a_present", "min_diameter", "max_diameter", "median_diameter", "inner_area", "outer_area", "intensity", "xmin", "xmax", "ymin", "ymax", "l_quantity", "l_linenumber", "l_orderkey", "x", "y")
_ERROR = "abs(overlap_pct - CASE WHEN area > 0 THEN 100.0e0 * overlap_area / area END)"

query("quality_control", f"""{V} SELECT job, count(*) AS n_objects, count(*) - count(DISTINCT object_id) AS duplicate_ids, {' + '.join(f'count(*) - count({c})' for c in _QC_COLUMNS)} AS missing_values,
 {_N('area <= 0')} AS nonpositive_area, {_N('overlap_area < 0')} AS negative_overlap, {_N('overlap_area > area + 1e-6')} AS overlap_exceeds_area, {_N('overlap_pct < 0 OR overlap_pct > 100')} AS pct_outside,
 {_N(f'coalesce(NOT ({_ERROR} <= 0.001e0), true)')} AS formula_mismatch, {_r(f'max({_ERROR})', 'max_formula_error')}, {_N('(overlap_area > 0) <> (a_present AND b_present)')} AS presence_mismatch,
 {_N(f'NOT CASE WHEN {A} THEN a_present ELSE b_present END')} AS own_marker_absent, {_N(_ANY_ZERO)} AS any_zero_diameter, {_N('least(min_diameter, median_diameter, max_diameter) < 0')} AS any_negative_diameter,
 {_N('min_diameter > median_diameter OR median_diameter > max_diameter')} AS diameter_order_mismatch, {_N(_ZERO_BOX)} AS zero_box, {_N('xmin > xmax OR ymin > ymax')} AS reversed_box,
 {_N('inner_area <> 0')} AS nonzero_inner_area, {_N('abs(inner_area + outer_area - area) > 0.001e0')} AS area_partition_mismatch FROM v GROUP BY job""")(summary.quality_control)

query("run_summary", f"""{V} SELECT job, {_N(A)} AS n_a, {_N(B)} AS n_b, {_r(_pct(_N(A + ' AND b_present'), _N(A)), 'association_pct')}, {', '.join(f'{f}({c}) AS {c}_{f}' for c in 'xy' for f in ('min', 'max'))} FROM v GROUP BY job""")(summary.run_summary)

query("type_weighting", f"""{V}, p AS (SELECT job, object_type, count(*) AS n, {_N('b_present')} AS k FROM v GROUP BY job, object_type)
SELECT object_type, count(*) AS n_exports, {_r('avg(100.0e0 * k / n)', 'equal_mean_pct')}, {_r('100.0e0 * sum(k) / sum(n)', 'pooled_pct')} FROM p GROUP BY object_type""")(summary.type_weighting)

_SECTIONS = f"s AS (SELECT job, arm, grp, animal, 100.0e0 * {_N(A + ' AND b_present')} / {_N(A)} AS association_pct FROM v GROUP BY job, arm, grp, animal)"


@query("hierarchical_means", f"""{V}, {_SECTIONS}, m AS (SELECT arm, grp, animal, avg(association_pct) AS m, count(*) AS k FROM s GROUP BY arm, grp, animal)
SELECT arm, grp, count(*) AS n_replicates, CAST(sum(k) AS BIGINT) AS n_sections, {_r('avg(m)', 'mean_pct')} FROM m GROUP BY arm, grp""")
def _hierarchy(v):
    return summary.hierarchical_means(summary.animal_summary(v, ("job", "arm", "grp", "animal")), "association_pct")


query("animal_summary", f"""{V} SELECT arm, grp, animal, {_N(A)} AS n_a, {_N(B)} AS n_b, {_N(A + ' AND b_present')} AS k_a, {_r(_pct(_N(A + ' AND b_present'), _N(A)), 'association_pct')},
 {_r(f'sum(area) FILTER (WHERE {A})', 'area_a')}, {_r(f'sum(area) FILTER (WHERE {A} AND b_present)', 'positive_area')}, {_r(f'sum(area) FILTER (WHERE {A} AND NOT b_present)', 'negative_area')},
 {_r(f'100.0e0 * sum(area) FILTER (WHERE {A} AND b_present) / sum(area) FILTER (WHERE {A})', 'area_positive_pct')} FROM v GROUP BY arm, grp, animal""")(summary.animal_summary)

_STRATUM = "CASE WHEN area >= 1 THEN 4 WHEN area >= 0.3e0 THEN 3 WHEN area >= 0.1e0 THEN 2 WHEN area >= 0.03e0 THEN 1 WHEN area >= 0 THEN 0 END"


@query("size_strata", f"""{V}, c AS (SELECT job, {_STRATUM} AS stratum, count(*) AS n, {_N('b_present')} AS k FROM v WHERE {A} GROUP BY ALL),
 s AS (SELECT j.job, CAST(i.i AS INT) AS stratum FROM (SELECT DISTINCT job FROM v) j, (SELECT unnest(generate_series(0, 4)) AS i) i),
 d AS (SELECT s.job, s.stratum, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM s LEFT JOIN c ON s.job = c.job AND s.stratum = c.stratum)
SELECT job, stratum, n, k, {_r(_pct('k', 'n'), 'rate_pct')}, {_r('100.0e0 * n / sum(n) OVER (PARTITION BY job)', 'share_pct')} FROM d""")
def _strata(v):
    return summary.size_strata(v, SIZE_EDGES)


@query("area_sensitivity", f"""{V}, t AS (SELECT unnest([{', '.join(f'{t}e0' for t in AREA_THRESHOLDS)}]) AS threshold)
SELECT job, threshold, {_N('area >= threshold')} AS kept, {_N('area >= threshold AND b_present')} AS positive, {_r(_pct(_N('area >= threshold AND b_present'), _N('area >= threshold')), 'rate_pct')} FROM v, t WHERE {A} GROUP BY job, threshold""")
def _sensitivity(v):
    return summary.area_sensitivity(v, AREA_THRESHOLDS)


query("overview", f"""{V} SELECT job, {_r(_pct(_N(A + ' AND b_present'), _N(A)), 'a_with_b_pct')}, {_r(_pct(_N(B + ' AND a_present'), _N(B)), 'b_with_a_pct')}, {_r(f'100.0e0 * sum(overlap_area) FILTER (WHERE {A}) / sum(area) FILTER (WHERE {A})', 'area_overlap_pct')} FROM v GROUP BY job""")(summary.overview)

query("overlap_states", f"""{V} SELECT job, object_type, count(*) AS n, {', '.join(f'{_N(c)} AS {s}_n' for s, c in (('zero', 'overlap_pct = 0'), ('partial', 'overlap_pct > 0 AND overlap_pct < 100'), ('full', 'overlap_pct = 100')))},
 {', '.join(_r(f'100.0e0 * {_N(c)} / count(*)', f'{s}_pct') for s, c in (('zero', 'overlap_pct = 0'), ('partial', 'overlap_pct > 0 AND overlap_pct < 100'), ('full', 'overlap_pct = 100')))} FROM v GROUP BY job, object_type""")(summary.overlap_states)

_FEATURES = {"a_marker": "a_present", "b_marker": "b_present", "zero_minimum": "min_diameter = 0"}


@query("feature_prevalence", V + " " + " UNION ALL ".join(f"SELECT job, object_type, count(*) AS n, '{f}' AS feature, {_N(c)} AS k, {_r(f'100.0e0 * {_N(c)} / count(*)', 'pct')} FROM v GROUP BY job, object_type" for f, c in _FEATURES.items()))
def _features(v):
    return summary.feature_prevalence(v, {f: F.expr(c) for f, c in _FEATURES.items()})


query("section_counts", f"{V} SELECT arm, count(DISTINCT job) FILTER (WHERE grp = 'control') AS control, count(DISTINCT job) FILTER (WHERE grp = 'treated') AS treated FROM v GROUP BY arm")(summary.section_counts)


@query("pct_of_total", f"{V}, c AS (SELECT arm, grp, animal, count(*) AS n FROM v WHERE {A} GROUP BY arm, grp, animal) SELECT arm, grp, animal, n, {_r('100.0e0 * n / sum(n) OVER (PARTITION BY arm, grp)', 'pct_of_total')} FROM c")
def _pct_of_total(v):
    return summary.pct_of_total(v.where(A).groupBy("arm", "grp", "animal").agg(F.count("*").alias("n")), "n", ("arm", "grp"))


@query("ecdf", f"""{V}, c AS (SELECT arm, object_type, overlap_pct, count(*) AS n FROM v GROUP BY arm, object_type, overlap_pct)
SELECT arm, object_type, round(overlap_pct, {DIGITS}) AS overlap_pct, n, {_r('100.0e0 * sum(n) OVER (PARTITION BY arm, object_type ORDER BY overlap_pct) / sum(n) OVER (PARTITION BY arm, object_type)', 'cumulative_pct')} FROM c""")
def _ecdf(v):
    return distribution.ecdf(v, "overlap_pct", ("arm", "object_type"))


@query("area_concentration", f"""{V}, r AS (SELECT job, object_type, object_id, row_number() OVER w AS rank, count(*) OVER p AS n, sum(area) OVER w AS s, sum(area) OVER p AS t FROM v
 WINDOW p AS (PARTITION BY job, object_type), w AS (PARTITION BY job, object_type ORDER BY area DESC, object_id ROWS UNBOUNDED PRECEDING))
SELECT job, object_type, object_id, CAST(rank AS INT) AS rank, round(100.0e0 * rank / n, 6) AS objects_pct, round(100.0e0 * s / t, 6) AS value_pct FROM r""", 6)
def _concentration(v):
    return distribution.concentration(v, "area", ("job", "object_type"))


@query("quantile_curve", f"""{V}, p AS (SELECT i / 20.0e0 AS probability, i FROM (SELECT unnest(generate_series(0, 20)) AS i)), s AS (SELECT job, list_sort(list(area)) AS a, count(*) AS n FROM v WHERE {A} GROUP BY job)
SELECT job, round(a[CAST(floor((n - 1) * probability) AS BIGINT) + 1] + ((n - 1) * probability - floor((n - 1) * probability)) * (a[CAST(ceil((n - 1) * probability) AS BIGINT) + 1] - a[CAST(floor((n - 1) * probability) AS BIGINT) + 1]), {DIGITS}) AS value, round(probability, {DIGITS}) AS probability FROM s, p""")
def _curve(v):
    return distribution.quantile_curve(v.where(A), "area", ("job",), 21)


@query("top_objects", f"{V}, r AS (SELECT job, object_type, object_id, round(area, {DIGITS}) AS area, CAST(row_number() OVER (PARTITION BY job, object_type ORDER BY area DESC, object_id) AS INT) AS area_rank FROM v) SELECT * FROM r WHERE area_rank <= 5")
def _top(v):
    return distribution.top_rows(v.select("job", "object_type", "object_id", "area"), "area", ("job", "object_type"), 5, name="area_rank")


@query("argmin_target", f"""{V}, t AS (SELECT job, quantile_cont(area, 0.5) AS target FROM v WHERE {A} GROUP BY job),
 r AS (SELECT v.job, target, object_id, area, row_number() OVER (PARTITION BY v.job ORDER BY abs(area - target), object_id) AS k FROM v JOIN t ON v.job = t.job WHERE {A})
SELECT job, round(target, {DIGITS}) AS target, object_id, round(area, {DIGITS}) AS area FROM r WHERE k = 1""")
def _nearest_to(v):
    return distribution.nearest_to(v.where(A), "area", 0.5, ("job",))


@query("object_review_queue", f"""{V}, r AS (SELECT job, object_id, area, min_diameter, CAST(row_number() OVER (PARTITION BY job ORDER BY md5('7:' || object_id), object_id) AS INT) AS a, CAST(row_number() OVER (PARTITION BY job ORDER BY area DESC, object_id) AS INT) AS b FROM v),
 o AS (SELECT job, object_id, CAST(row_number() OVER (PARTITION BY job ORDER BY object_id) AS INT) AS c FROM v WHERE min_diameter = 0)
SELECT job, object_id, 'random' AS reason, a AS place FROM r WHERE a <= 3 UNION ALL SELECT job, object_id, 'largest', b FROM r WHERE b <= 3 UNION ALL SELECT job, object_id, 'odd', c FROM o WHERE c <= 2""")
def _queue(v):
    return distribution.review_queue(v, "area", F.col("min_diameter") == 0)


@query("largest_change", f"""{V}, {_SECTIONS}, d AS (SELECT a.animal, a.grp, b.association_pct - a.association_pct AS gap FROM s a JOIN s b ON a.animal = b.animal AND a.arm = 'arm1' AND b.arm = 'arm2'),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(gap) DESC, animal) AS k FROM d) SELECT grp, animal, round(gap, {DIGITS}) AS gap FROM r WHERE k = 1""")
def _largest_change(v):
    gaps = contrast.paired_arms(summary.animal_summary(v), "association_pct")
    return distribution.extreme_row(gaps, F.abs("gap"), ("grp",), ("animal", "gap"), "animal")


_RUNS = "CAST(job % 6 AS INT) AS pair, CASE WHEN job < 6 THEN 'first' ELSE 'second' END AS run, CAST(floor(area * 10) AS INT) AS size, b_present, object_type"


def _runs(v):
    return v.withColumn("pair", (F.col("job") % 6).cast("int")).withColumn("run", F.when(F.col("job") < 6, "first").otherwise("second"))


@query("signature_multiset", f"""{V}, c AS (SELECT pair, object_type, size, b_present, {_N("run = 'first'")} AS a, {_N("run = 'second'")} AS b FROM (SELECT {_RUNS} FROM v) GROUP BY ALL)
SELECT pair, object_type, CAST(sum(least(a, b)) AS BIGINT) AS shared, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS first_only, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS second_only FROM c GROUP BY pair, object_type""")
def _multiset(v):
    rows = _runs(v).withColumn("size", F.floor(F.col("area") * 10).cast("int"))
    return multiset.shared_signatures(rows, "run", ("first", "second"), ("size", "b_present"), ("pair", "object_type"))


#: Every measurement of an object: what two exports of one object agree in.
SIGNATURE = ("overlap_area", "overlap_pct", "area", "inner_area", "outer_area", "intensity", "min_diameter", "max_diameter", "median_diameter", "a_present", "b_present", "xmin", "xmax", "ymin", "ymax", "l_linenumber")


def _identical_sql(drop: bool) -> str:
    known = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SIGNATURE) if drop else ""
    return f"""SELECT {str(not drop).lower()} AS unknowns_match, job, object_type, CAST(sum(a) AS BIGINT) AS n_first, CAST(sum(b) AS BIGINT) AS n_second, CAST(sum(least(a, b)) AS BIGINT) AS shared, CAST(sum(a) - sum(least(a, b)) AS BIGINT) AS first_only, CAST(sum(b) - sum(least(a, b)) AS BIGINT) AS second_only,
 {_r('CASE WHEN sum(b) > 0 THEN 100.0e0 * sum(least(a, b)) / sum(b) END', 'identical_pct')} FROM (SELECT job, object_type, {', '.join(SIGNATURE)}, {_N("run = 'first'")} AS a, {_N("run = 'second'")} AS b FROM u {known} GROUP BY ALL) GROUP BY job, object_type"""


@query("identical_signatures", f"""{V}, u AS (SELECT *, 'first' AS run FROM v UNION ALL SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN area + 1 ELSE area END AS area), 'second' FROM v WHERE l_linenumber <> 4 UNION ALL SELECT *, 'second' FROM v WHERE l_linenumber = 2)
{_identical_sql(True)} UNION ALL {_identical_sql(False)}""")
def _identical(v):
    """A second run that lacks some rows, has others twice, and measured some anew."""
    second = v.where("l_linenumber <> 4").withColumn("area", F.when(F.col("l_linenumber") == 3, F.col("area") + 1).otherwise(F.col("area"))).unionByName(v.where("l_linenumber = 2"))
    both = v.withColumn("run", F.lit("first")).unionByName(second.withColumn("run", F.lit("second")))
    out = None
    for drop in (True, False):
        one = multiset.identical_signatures(both, "run", ("first", "second"), SIGNATURE, ("job", "object_type"), drop).withColumn("unknowns_match", F.lit(not drop))
        out = one if out is None else out.unionByName(one)
    return out


@query("signature_overlap", f"""{V}, c AS (SELECT pair, size, b_present, odd, {_N("run = 'first'")} AS a, {_N("run = 'second'")} AS b FROM (SELECT {_RUNS}, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS odd FROM v) GROUP BY ALL)
SELECT pair, CAST(sum(least(a, b)) AS BIGINT) AS shared, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS first_only, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS second_only FROM c GROUP BY pair""")
def _overlap(v):
    rows = _runs(v).withColumn("size", F.floor(F.col("area") * 10).cast("int")).withColumn("odd", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")))
    return multiset.shared_signatures(rows, "run", ("first", "second"), ("size", "b_present", "odd"), ("pair",), drop_unknown=False)


def _side_sql(run: str, name: str) -> str:
    on = f"{A} AND run = '{run}'"
    return f"{_N(on)} AS n_{name}, 100.0e0 * {_N(on + ' AND b_present')} / {_N(on)} AS association_{name}, avg(overlap_pct) FILTER (WHERE {on}) AS mean_overlap_{name}, 100.0e0 * sum(overlap_area) FILTER (WHERE {on}) / sum(area) FILTER (WHERE {on}) AS pooled_overlap_{name}, quantile_cont(area, 0.5) FILTER (WHERE {on}) AS median_area_{name}"


_M = ("association", "mean_overlap", "pooled_overlap", "median_area")


@query("paired_metrics", f"""{V}, p AS (SELECT pair, {_side_sql('first', 'first')}, {_side_sql('second', 'second')} FROM (SELECT *, CAST(job % 6 AS INT) AS pair, CASE WHEN job < 6 THEN 'first' ELSE 'second' END AS run FROM v) GROUP BY pair)
SELECT pair, n_first, n_second, {', '.join(_r(f'{m}_{s}', f'{m}_{s}') for s in ('first', 'second') for m in _M)}, {_r('100.0e0 * (n_second - n_first) / n_first', 'n_change_pct')}, {', '.join(_r(f'{m}_second - {m}_first', f'{m}_change') for m in _M)} FROM p""")
def _paired_metrics(v):
    return multiset.paired_metrics(_runs(v), "run", ("first", "second"), "pair")


def _grid_sql(width: float, convention: str, keys: str = "job", source: str = "w") -> str:
    hi = {"zero": "CAST(floor({c}_hi / {w}) - floor({c}_lo / {w}) + 1 AS BIGINT)", "points": "CAST(floor({c}_hi / {w}) - floor({c}_lo / {w}) + 1 AS BIGINT)", "closed": "CAST(greatest(ceil({c}_hi / {w}) - floor({c}_lo / {w}), 1) AS BIGINT)"}[convention]
    n = lambda c: hi.format(c=c, w=f"{width}e0")
    at = lambda c: f"least(CAST(floor(({c} - {c}0) / {width}e0) AS BIGINT), n{c} - 1)"
    return f"""e AS (SELECT {keys}, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM {source} GROUP BY {keys}),
 f AS (SELECT {keys}, floor(x_lo / {width}e0) * {width}e0 AS x0, floor(y_lo / {width}e0) * {width}e0 AS y0, {n('x')} AS nx, {n('y')} AS ny FROM e),
 b AS (SELECT {source}.*, {at('x')} AS ix, {at('y')} AS iy FROM {source} JOIN f USING ({keys})),
 sp AS (SELECT {keys}, ix, unnest(generate_series(0, ny - 1)) AS iy FROM (SELECT {keys}, ny, unnest(generate_series(0, nx - 1)) AS ix FROM f))"""


def _dense(keys: str, counts: dict) -> str:
    cells = ", ".join(f"{e} AS {n}" for n, e in counts.items())
    return f"c AS (SELECT {keys}, ix, iy, {cells} FROM b GROUP BY {keys}, ix, iy), g AS (SELECT {keys}, ix, iy, {', '.join(f'coalesce({n}, 0) AS {n}' for n in counts)} FROM sp LEFT JOIN c USING ({keys}, ix, iy))"


_BASIC = {"n_a": _N(A), "n_b": _N(B), "positive": _N(A + " AND b_present"), "overlap_pct_sum": f"coalesce(sum(overlap_pct) FILTER (WHERE {A}), 0.0e0)"}


@query("zero_grid", f"""{_VX}, {_grid_sql(WIDTH, 'zero')}, {_dense('job', _BASIC)}
SELECT job, ix, iy, n_a, n_b, positive, {_r('overlap_pct_sum', 'overlap_pct_sum')}, {_r(_pct('positive', 'n_a'), 'fraction_pct')}, {_r('CASE WHEN n_a > 0 THEN overlap_pct_sum / n_a END', 'mean_overlap_pct')}, n_a >= 10 AS supported, {_r('CASE WHEN n_a >= 10 THEN 100.0e0 * positive / n_a END', 'display_pct')} FROM g""")
def _zero_grid(v):
    return grid.fraction_grid(_spread(v), WIDTH, 10, "zero")


@query("native_grid", f"""{_VX}, {_grid_sql(WIDTH, 'closed')}, {_dense('job', _BASIC)}
SELECT job, ix, iy, n_a, n_b, positive, {_r('overlap_pct_sum', 'overlap_pct_sum')}, {_r(_pct('positive', 'n_a'), 'fraction_pct')}, {_r('CASE WHEN n_a > 0 THEN overlap_pct_sum / n_a END', 'mean_overlap_pct')}, n_a >= 10 AS supported, {_r('CASE WHEN n_a >= 10 THEN 100.0e0 * positive / n_a END', 'display_pct')} FROM g""")
def _native_grid(v):
    return grid.fraction_grid(_spread(v), WIDTH, 10, "closed")


@query("count_scales", f"{_VX}, {_grid_sql(WIDTH, 'closed')}, {_dense('job', _BASIC)} SELECT max(n_a) AS max_n_a, max(n_b) AS max_n_b FROM g")
def _scales(v):
    return grid.count_scales(grid.fraction_grid(_spread(v), WIDTH, 10, "closed"))


_LAYERS = {
    "n_all": "count(*)", "n_a": _N(A), "n_b": _N(B), "positive": _N(A + " AND b_present"), "negative": _N(A + " AND NOT b_present"), "large": _N(A + " AND area >= 1"), "small": _N(A + " AND area < 0.1e0"),
    "area_a": f"coalesce(sum(area) FILTER (WHERE {A}), 0.0e0)", "positive_area": f"coalesce(sum(area) FILTER (WHERE {A} AND b_present), 0.0e0)", "overlap_area": f"coalesce(sum(overlap_area) FILTER (WHERE {A}), 0.0e0)",
}


@query("analysis_grid", f"""{_VX}, {_grid_sql(WIDTH, 'closed')}, {_dense('job', _LAYERS)}
SELECT job, ix, iy, n_all, n_a, n_b, positive, negative, large, small, {_r('area_a', 'area_a')}, {_r('positive_area', 'positive_area')}, {_r('overlap_area', 'overlap_area')}, {_r('CASE WHEN n_a >= 10 THEN 100.0e0 * positive / n_a END', 'association_pct')},
 {_r('CASE WHEN n_a >= 10 AND area_a > 0 THEN 100.0e0 * overlap_area / area_a END', 'area_overlap_pct')}, {_r('CASE WHEN small >= 10 THEN CAST(large AS DOUBLE) / small END', 'large_small_ratio')}, n_a >= 10 AS supported FROM g""")
def _analysis(v):
    return grid.analysis_grid(_spread(v), WIDTH, 10)


@query("paired_grid", f"""{_VX}, q AS (SELECT *, CAST(job % 6 AS INT) AS pair, CASE WHEN job < 6 THEN 'first' ELSE 'second' END AS run FROM w), {_grid_sql(WIDTH, 'zero', 'pair', 'q')},
 c AS (SELECT pair, object_type, ix, iy, {_N("run = 'first'")} AS n1, {_N("run = 'second'")} AS n2 FROM b GROUP BY ALL)
SELECT pair, t.object_type, ix, iy, coalesce(n1, 0) AS n_first, coalesce(n2, 0) AS n_second, coalesce(n2, 0) - coalesce(n1, 0) AS delta FROM sp JOIN (SELECT DISTINCT pair, object_type FROM q) t USING (pair) LEFT JOIN c USING (pair, object_type, ix, iy)""")
def _paired_grid(v):
    return grid.paired_grid(_runs(_spread(v)), WIDTH, "run", ("first", "second"))


@query("aligned_rerun", f"""{_VX}, {_grid_sql(WIDTH, 'closed')}, {_dense('job', {'n_short': _N('l_linenumber <= 3 AND x BETWEEN 1000 AND 8000 AND y BETWEEN 1000 AND 4000'), 'n_full': 'count(*)'})} SELECT job, ix, iy, n_short, n_full FROM g""")
def _rerun(v):
    full = _spread(v)
    return grid.aligned_rerun(full.where("l_linenumber <= 3 and x between 1000 and 8000 and y between 1000 and 4000"), full, WIDTH, ("job",))


_SIGMA_R = 4


@query("smoothed_fraction", f"""{_VX}, {_grid_sql(WIDTH, 'zero')}, {_dense('job', _BASIC)},
 o AS (SELECT i.i AS dx, j.i AS dy, exp(-(i.i * i.i + j.i * j.i) / 2.0e0) AS wt FROM (SELECT unnest(generate_series(-{_SIGMA_R}, {_SIGMA_R})) AS i) i, (SELECT unnest(generate_series(-{_SIGMA_R}, {_SIGMA_R})) AS i) j),
 m AS (SELECT job, ix + dx AS ix, iy + dy AS iy, sum(n_a * wt) AS n, sum(positive * wt) AS k FROM g, o WHERE n_a > 0 GROUP BY job, ix + dx, iy + dy)
SELECT job, ix, iy, n_a, {_r('CASE WHEN n_a >= 10 THEN 100.0e0 * k / n END', 'smoothed_pct')} FROM g LEFT JOIN m USING (job, ix, iy)""")
def _smooth(v):
    return grid.smoothed_fraction(grid.fraction_grid(_spread(v), WIDTH, 10, "zero"), 1.0)


def _support_sql(width):
    return f"SELECT job, threshold, count(*) AS occupied, {_N('n >= threshold')} AS supported, CAST(coalesce(sum(n) FILTER (WHERE n >= threshold), 0) AS BIGINT) AS objects_supported, CAST(sum(n) AS BIGINT) AS objects, {width}e0 AS width, {_r('100.0e0 * coalesce(sum(n) FILTER (WHERE n >= threshold), 0) / sum(n)', 'objects_pct')} FROM c{int(width)}, (SELECT unnest([5, 10, 20]) AS threshold) GROUP BY job, threshold"


@query("support_sensitivity", f"{_VX}, q AS (SELECT * FROM w WHERE {A})" + "".join(f", c{w} AS (SELECT job, count(*) AS n FROM (WITH {_grid_sql(float(w), 'closed', 'job', 'q')} SELECT job, ix, iy FROM b) GROUP BY job, ix, iy)" for w in (500, 1000, 2000)) + " " + " UNION ALL ".join(_support_sql(float(w)) for w in (500, 1000, 2000)))
def _support(v):
    return grid.support_sensitivity(_spread(v), (500.0, 1000.0, 2000.0), (5, 10, 20))


@query("size_overlap_hist", f"""{V}, a AS (SELECT * FROM v WHERE {A} AND area > 0), e AS (SELECT ln(min(area)) AS lo, (ln(max(area) * (1 + 1e-10)) - ln(min(area))) / 12 AS step FROM a),
 c AS (SELECT job, CAST(least(floor((ln(area) - lo) / step), 11) AS BIGINT) AS ia, CAST(least(floor(overlap_pct / 4.0e0), 24) AS BIGINT) AS io, count(*) AS n FROM a, e GROUP BY ALL)
SELECT job, ia, io, coalesce(n, 0) AS n FROM (SELECT job, ia, io FROM (SELECT DISTINCT job FROM a), (SELECT unnest(generate_series(0, 11)) AS ia), (SELECT unnest(generate_series(0, 24)) AS io)) LEFT JOIN c USING (job, ia, io)""")
def _hist(v):
    return grid.size_overlap_histogram(v, 12, 25)


_FRACTION = f"p AS (SELECT arm, grp, job, CAST(floor(x / 2000.0e0) AS BIGINT) AS ix, CAST(floor(y / 2000.0e0) AS BIGINT) AS iy, CASE WHEN count(*) >= 5 THEN 100.0e0 * {_N('b_present')} / count(*) END AS m FROM w WHERE {A} GROUP BY ALL)"


@query("equal_maps", f"{_VX}, {_FRACTION} SELECT arm, grp, ix, iy, count(m) AS n, {_r('CASE WHEN count(m) >= 3 THEN avg(m) END', 'mean')} FROM p GROUP BY arm, grp, ix, iy")
def _equal_maps(v):
    a = _spread(v).where(A).withColumn("ix", F.floor(F.col("x") / 2000.0)).withColumn("iy", F.floor(F.col("y") / 2000.0))
    per = a.groupBy("arm", "grp", "job", "ix", "iy").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    return grid.equal_maps(per.withColumn("m", F.when(F.col("n") >= 5, percent("k", "n"))), "m")


_FLIP = "CASE WHEN job % 4 IN (1, 3) THEN -1 ELSE 1 END * (x - 5000.0e0) AS tx, CASE WHEN job % 4 IN (2, 3) THEN -1 ELSE 1 END * (y - 2500.0e0) AS ty"


def _transformed(v):
    o = F.element_at(F.array(*map(F.lit, ("none", "x", "y", "both"))), (F.col("job") % 4 + 1).cast("int"))
    rows = _spread(v).withColumn("o", o)
    tx, ty = flipped("x", "y", F.lit(5000.0), F.lit(2500.0), "o")
    return rows.withColumn("tx", tx).withColumn("ty", ty)


@query("registered_maps", f"""{_VX}, t AS (SELECT *, {_FLIP} FROM w WHERE {A}),
 p AS (SELECT arm, grp, job, CAST(least(floor((tx + 30000.0e0) / 2000.0e0), 29) AS BIGINT) AS ix, CAST(least(floor((ty + 30000.0e0) / 2000.0e0), 29) AS BIGINT) AS iy, CASE WHEN count(*) >= 5 THEN 100.0e0 * {_N('b_present')} / count(*) END AS m FROM t WHERE abs(tx) <= 30000 AND abs(ty) <= 30000 GROUP BY ALL),
 e AS (SELECT arm, grp, ix, iy, CASE WHEN count(m) >= 3 THEN avg(m) END AS mean FROM p GROUP BY arm, grp, ix, iy)
SELECT arm, ix, iy, {_r("max(mean) FILTER (WHERE grp = 'treated') - max(mean) FILTER (WHERE grp = 'control')", 'difference')} FROM e GROUP BY arm, ix, iy""")
def _registered(v):
    return grid.map_difference(grid.registered_maps(_transformed(v), 2000.0, 5))


@query("coverage", f"{_VX}, t AS (SELECT *, {_FLIP} FROM w) SELECT arm, grp, CAST(floor(tx / 2000.0e0) AS BIGINT) AS ix, CAST(floor(ty / 2000.0e0) AS BIGINT) AS iy, count(DISTINCT job) AS n_sections FROM t GROUP BY ALL")
def _coverage(v):
    return grid.coverage(_transformed(v), 2000.0)


@query("review_cells", f"""{_VX}, {_grid_sql(WIDTH, 'closed')}, {_dense('job', _LAYERS)}, r AS (SELECT job, ix, iy, n_a, row_number() OVER (PARTITION BY job ORDER BY n_a DESC, iy, ix) AS k FROM g) SELECT job, ix, iy, n_a FROM r WHERE k = 1""")
def _review_cells(v):
    return grid.argmax_cells(grid.analysis_grid(_spread(v), WIDTH, 10).select("job", "ix", "iy", "n_a"), "n_a")


@query("hotspot", f"""{_VX}, q AS (SELECT * FROM w WHERE {A}), {_grid_sql(WIDTH, 'zero', 'job', 'q')}, c AS (SELECT job, ix, iy, row_number() OVER (PARTITION BY job ORDER BY count(*) DESC, iy, ix) AS k FROM b GROUP BY job, ix, iy),
 m AS (SELECT job, x0 + (ix + 0.5e0) * {WIDTH}e0 AS cx, y0 + (iy + 0.5e0) * {WIDTH}e0 AS cy FROM c JOIN f USING (job) WHERE k = 1),
 n AS (SELECT q.job, x AS fx, y AS fy, row_number() OVER (PARTITION BY q.job ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), object_id) AS k FROM q JOIN m ON q.job = m.job)
SELECT w.job, object_id, fx, fy FROM w JOIN n ON w.job = n.job AND k = 1 WHERE xmax >= fx - 75 AND xmin <= fx + 75 AND ymax >= fy - 75 AND ymin <= fy + 75""")
def _hotspot(v):
    moved = _spread(v)
    return grid.hotspot(moved).select("job", "object_id", "fx", "fy")


_REP = f"""r AS (SELECT arm, grp, animal, 100.0e0 * {_N('b_present')} / count(*) AS association_pct, avg(area) AS mean_area FROM v WHERE {A} GROUP BY arm, grp, animal),
 l AS (SELECT arm, grp, animal, 'association_pct' AS metric, association_pct AS value FROM r UNION ALL SELECT arm, grp, animal, 'mean_area', mean_area FROM r)"""


def _long(v):
    return contrast.long_metrics(summary.replicate_metrics(v), ("association_pct", "mean_area"))


query("replicate_metrics", f"""{V} SELECT arm, grp, animal, count(*) AS n, CAST(0 AS BIGINT) AS missing_flags, CAST(0 AS BIGINT) AS missing_areas, {_r('100.0e0 * ' + _N('b_present') + ' / count(*)', 'association_pct')}, CAST({_N('b_present')} AS DOUBLE) AS positive_count, {_r('sum(area)', 'area_sum')}, {_r('avg(area)', 'mean_area')},
 {_r('sum(overlap_area)', 'overlap_sum')}, {_r('100.0e0 * sum(overlap_area) / sum(area)', 'area_overlap_pct')}, {_r('sum(overlap_area) / count(*)', 'overlap_per_object')} FROM v WHERE {A} GROUP BY arm, grp, animal""")(summary.replicate_metrics)


@query("condition_contrast", f"""{V}, {_REP}, m AS (SELECT arm, metric, avg(value) FILTER (WHERE grp = 'control') AS a, avg(value) FILTER (WHERE grp = 'treated') AS b, {_N("grp = 'control'")} AS na, {_N("grp = 'treated'")} AS nb FROM l GROUP BY arm, metric)
SELECT arm, metric, {_r('a', 'control_mean')}, {_r('b', 'treated_mean')}, na AS control_n, nb AS treated_n, {_r('a - b', 'difference')} FROM m""")
def _contrast(v):
    return contrast.contrast(_long(v))


_OUT = "o AS (SELECT arm, metric, grp, animal, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS m FROM l WINDOW w AS (PARTITION BY arm, metric, grp))"


@query("leave_pair_out", f"""{V}, {_REP}, {_OUT}, d AS (SELECT a.arm, a.metric, a.m - b.m AS d FROM o a JOIN o b ON a.arm = b.arm AND a.metric = b.metric AND a.grp = 'control' AND b.grp = 'treated')
SELECT arm, metric, count(*) AS n_pairs, {_r('min(d)', 'low')}, {_r('max(d)', 'high')} FROM d GROUP BY arm, metric""")
def _leave_out(v):
    return contrast.leave_pair_out(_long(v))


@query("cross_replicate", f"{V}, {_REP} SELECT a.arm, a.metric, a.animal AS control_id, b.animal AS treated_id, {_r('a.value - b.value', 'difference')} FROM l a JOIN l b ON a.arm = b.arm AND a.metric = b.metric AND a.grp = 'control' AND b.grp = 'treated'")
def _cross(v):
    return contrast.cross_replicate(_long(v))


@query("exact_allocation", f"""{V}, {_REP}, c AS (SELECT a.arm, a.metric, (a.value + b.value + c.value) / 3 AS s, (a.value + b.value + c.value) AS t, a.grp = 'control' AND b.grp = 'control' AND c.grp = 'control' AS observed FROM l a JOIN l b ON a.arm = b.arm AND a.metric = b.metric AND a.animal < b.animal JOIN l c ON a.arm = c.arm AND a.metric = c.metric AND b.animal < c.animal),
 d AS (SELECT c.arm, c.metric, observed, s - (tt - t) / 3 AS d FROM c JOIN (SELECT arm, metric, sum(value) AS tt FROM l GROUP BY arm, metric) z ON c.arm = z.arm AND c.metric = z.metric), o AS (SELECT arm, metric, d AS od FROM d WHERE observed)
SELECT d.arm, d.metric, count(*) AS n_allocations, {_r('max(od)', 'observed_difference')}, {_r('avg(CASE WHEN abs(d) >= abs(od) - 1e-12 THEN 1.0e0 ELSE 0.0e0 END)', 'p')} FROM d JOIN o ON d.arm = o.arm AND d.metric = o.metric GROUP BY d.arm, d.metric""")
def _allocation(v):
    return contrast.exact_allocation(_long(v))


_CELLS = f"""s AS (SELECT arm, grp, animal, {_STRATUM} AS stratum, count(*) AS n, {_N('b_present')} AS k FROM v WHERE {A} GROUP BY ALL),
 e AS (SELECT *, min(n) OVER (PARTITION BY arm, stratum) >= 45 AND count(*) OVER (PARTITION BY arm, stratum) = 6 AS ok FROM s),
 h AS (SELECT *, CASE WHEN ok THEN CAST(n AS DOUBLE) / sum(n) FILTER (WHERE ok) OVER (PARTITION BY arm, animal) END AS share FROM e), w AS (SELECT *, avg(share) OVER (PARTITION BY arm, stratum) AS wt FROM h),
 r AS (SELECT arm, grp, animal, 100.0e0 * sum(k) / sum(n) AS raw, 100.0e0 * sum(k) FILTER (WHERE ok) / sum(n) FILTER (WHERE ok) AS restricted, 100.0e0 * sum(wt * k / n) FILTER (WHERE ok) AS standardized, 100.0e0 * coalesce(sum(n) FILTER (WHERE ok), 0) / sum(n) AS retained_pct FROM w GROUP BY arm, grp, animal)"""


def _strata_cells(v):
    from ..functions import stratum

    return v.where(A).groupBy("arm", "grp", "animal", stratum("area", SIZE_EDGES).alias("stratum")).agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))


@query("stratum_means", f"""{V}, s AS (SELECT arm, grp, animal, {_STRATUM} AS stratum, 100.0e0 * {_N('b_present')} / count(*) AS rate FROM v WHERE {A} GROUP BY ALL)
SELECT arm, stratum, {', '.join(f"round(avg(rate) FILTER (WHERE grp = '{g}'), {DIGITS}) AS {g}_mean, count(*) FILTER (WHERE grp = '{g}') AS {g}_n" for g in ('control', 'treated'))}, {_r("avg(rate) FILTER (WHERE grp = 'control') - avg(rate) FILTER (WHERE grp = 'treated')", 'difference')} FROM s GROUP BY arm, stratum""")
def _stratum_means(v):
    return summary.stratum_means(_strata_cells(v))


@query("design_counts", f"{V} SELECT 'image ' || (job % 3) AS image, arm, grp, count(DISTINCT job) AS n_sections FROM v GROUP BY ALL")
def _design_counts(v):
    return summary.design_counts(v.select("job", "arm", "grp", F.concat(F.lit("image "), (F.col("job") % 3).cast("string")).alias("image")))


@query("size_standardized", f"{V}, {_CELLS} SELECT arm, grp, animal, {', '.join(_r(c, c) for c in ('raw', 'restricted', 'standardized', 'retained_pct'))} FROM r")
def _standardized(v):
    return contrast.standardized(_strata_cells(v), 45)


@query("stratum_support", f"""{V}, s AS (SELECT arm, grp, animal, {_STRATUM} AS stratum, count(*) AS n FROM v WHERE {A} GROUP BY ALL), t AS (SELECT arm, stratum, min(n) AS least_n, count(*) AS present, {_N('n < 45')} AS below FROM s GROUP BY arm, stratum)
SELECT arm, stratum, least_n, present, below, present = 6 AND below = 0 AS eligible, concat_ws(', ', CASE WHEN present < 6 THEN 'replicate missing' END, CASE WHEN below > 0 THEN 'fewer than the minimum' END) AS reason FROM t""")
def _support_rule(v):
    return contrast.support(_strata_cells(v), 45)


@query("normalization_audit", f"""{V}, {_CELLS.replace('r AS (', 'z AS (')}, r AS (SELECT arm, grp, animal, count(*) AS n, {_N('b_present')} AS k, 100.0e0 * sum(overlap_area) / sum(area) AS o FROM v WHERE {A} GROUP BY arm, grp, animal),
 q AS (SELECT r.*, standardized FROM r JOIN z USING (arm, grp, animal))
SELECT arm, {_r("avg(100.0e0 * k / n) FILTER (WHERE grp = 'control') - avg(100.0e0 * k / n) FILTER (WHERE grp = 'treated')", 'equal_rate')}, {_r("avg(standardized) FILTER (WHERE grp = 'control') - avg(standardized) FILTER (WHERE grp = 'treated')", 'equal_standardized')},
 {_r("avg(o) FILTER (WHERE grp = 'control') - avg(o) FILTER (WHERE grp = 'treated')", 'equal_area_overlap')}, {_r("100.0e0 * sum(k) FILTER (WHERE grp = 'control') / sum(n) FILTER (WHERE grp = 'control') - 100.0e0 * sum(k) FILTER (WHERE grp = 'treated') / sum(n) FILTER (WHERE grp = 'treated')", 'pooled_rate')} FROM q GROUP BY arm""")
def _audit(v):
    rates = contrast.standardized(_strata_cells(v), 45).select("arm", "grp", "animal", "standardized")
    rows = summary.replicate_metrics(v).join(rates, ["arm", "grp", "animal"])
    return contrast.normalization_audit(rows.select("arm", "grp", "animal", "n", F.col("positive_count").alias("k"), "standardized", "area_overlap_pct"))


_DIR = f"m AS (SELECT arm, metric, avg(value) FILTER (WHERE grp = 'control') AS a, avg(value) FILTER (WHERE grp = 'treated') AS b, sqrt(var_samp(value) FILTER (WHERE grp = 'control') / 3 + var_samp(value) FILTER (WHERE grp = 'treated') / 3) AS se FROM l GROUP BY arm, metric)"


def _direction(name, x, y, low, high):
    return f"SELECT arm, metric, '{name}' AS direction, {_r(f'{x} - {y}', 'difference')}, {_r(_pct(f'({x} - {y})', y), 'relative_pct')}, {_r(f'CASE WHEN {y} > 0 THEN {x} / {y} END', 'ratio')}, {_r('se', 'se')}, {_r(f'CASE WHEN se > 0 THEN ({x} - {y}) / se END', 'per_se')}, {_r(low, 'low')}, {_r(high, 'high')} FROM m JOIN lo USING (arm, metric)"


_RANGE = f"{_OUT}, lo AS (SELECT a.arm, a.metric, min(a.m - b.m) AS low, max(a.m - b.m) AS high FROM o a JOIN o b ON a.arm = b.arm AND a.metric = b.metric AND a.grp = 'control' AND b.grp = 'treated' GROUP BY a.arm, a.metric)"


@query("directions", f"{V}, {_REP}, {_RANGE}, {_DIR} {_direction('control - treated', 'a', 'b', 'low', 'high')} UNION ALL {_direction('treated - control', 'b', 'a', '-high', '-low')}")
def _directions(v):
    return contrast.directions(_long(v))


@query("paired_arms", f"{V}, {_SECTIONS} SELECT a.animal, a.grp, {_r('a.association_pct', 'arm1')}, {_r('b.association_pct', 'arm2')}, {_r('b.association_pct - a.association_pct', 'gap')} FROM s a JOIN s b ON a.animal = b.animal AND a.arm = 'arm1' AND b.arm = 'arm2'")
def _paired_arms(v):
    return contrast.paired_arms(summary.animal_summary(v), "association_pct")


@query("layout_audit", f"""{V}, j AS (SELECT arm, grp, job, min(x) AS lo, max(x) AS hi, 100.0e0 * {_N(A + ' AND b_present')} / {_N(A)} AS rate FROM v GROUP BY arm, grp, job),
 i AS (SELECT arm, min(lo) FILTER (WHERE grp = 'control') AS control_lo, max(hi) FILTER (WHERE grp = 'control') AS control_hi, min(lo) FILTER (WHERE grp = 'treated') AS treated_lo, max(hi) FILTER (WHERE grp = 'treated') AS treated_hi, avg(rate) FILTER (WHERE grp = 'control') - avg(rate) FILTER (WHERE grp = 'treated') AS contrast FROM j GROUP BY arm)
SELECT arm, control_lo, control_hi, treated_lo, treated_hi, {_r('contrast', 'contrast')}, CASE WHEN control_hi < treated_lo THEN 'control lower' WHEN treated_hi < control_lo THEN 'treated lower' ELSE 'overlap' END AS x_order, CASE WHEN greatest(treated_lo - control_hi, control_lo - treated_hi) > 0 THEN greatest(treated_lo - control_hi, control_lo - treated_hi) END AS gap FROM i""")
def _layout(v):
    return geometry.layout_audit(v)


_EXTENTS = f"""{V}, t AS (SELECT arm, 'image ' || (job % 3) AS image, grp, animal, job, min(xmin) AS x_min, max(xmax) AS x_max, min(ymin) AS y_min, max(ymax) AS y_max, count(*) AS n_objects, {_N(A)} AS n_a,
  CASE WHEN {_N(A)} > 0 AND {_N(A)} = {_N(A + ' AND f IS NOT NULL')} THEN {_N(A + ' AND f')} END AS n_positive FROM (SELECT *, CASE WHEN job <> 4 OR l_linenumber < 7 THEN b_present END AS f FROM v) GROUP BY ALL),
 e AS (SELECT *, (x_min + x_max) / 2 AS x_mid, (y_min + y_max) / 2 AS y_mid, x_max - x_min AS x_size, y_max - y_min AS y_size, 100.0e0 * n_positive / n_a AS association_pct FROM t),
 c AS (SELECT arm, image, string_agg(CAST(animal AS VARCHAR), ', ' ORDER BY CAST(animal AS VARCHAR)) FILTER (WHERE grp = 'control') AS control_animals, string_agg(CAST(animal AS VARCHAR), ', ' ORDER BY CAST(animal AS VARCHAR)) FILTER (WHERE grp = 'treated') AS treated_animals,
  {_N("grp = 'control'")} AS n_control, {_N("grp = 'treated'")} AS n_treated, count(association_pct) = count(*) AS whole, avg(association_pct) FILTER (WHERE grp = 'control') AS a, avg(association_pct) FILTER (WHERE grp = 'treated') AS b,
  min(x_min) FILTER (WHERE grp = 'treated') - max(x_max) FILTER (WHERE grp = 'control') AS low, min(x_min) FILTER (WHERE grp = 'control') - max(x_max) FILTER (WHERE grp = 'treated') AS high FROM e GROUP BY arm, image),
 d AS (SELECT *, CASE WHEN whole THEN a - b END AS difference, CASE WHEN low > 0 THEN 'control lower' WHEN high > 0 THEN 'treated lower' ELSE 'overlap' END AS x_order FROM c)"""


def _extents(v):
    """Two sections of an arm share an image; one section has unknown flags."""
    flags = F.when((F.col("job") != 4) | (F.col("l_linenumber") < 7), F.col("b_present"))
    return geometry.section_extents(v.withColumn("image", F.concat(F.lit("image "), (F.col("job") % 3).cast("string"))).withColumn("b_present", flags))


@query("layout_sections", f"{_EXTENTS} SELECT arm, image, grp, animal, job, x_min, x_max, y_min, y_max, n_objects, n_a, n_positive, x_mid, x_size, y_mid, y_size, {_r('association_pct', 'association_pct')} FROM e")
def _layout_sections(v):
    return _extents(v)


@query("layout_contrasts", f"{_EXTENTS} SELECT arm, image, control_animals, treated_animals, n_control, n_treated, {_r('CASE WHEN whole THEN a END', 'control_mean')}, {_r('CASE WHEN whole THEN b END', 'treated_mean')}, {_r('difference', 'difference')}, x_order, greatest(low, high, 0) AS gap FROM d")
def _layout_contrasts(v):
    return geometry.layout_contrasts(_extents(v))


@query("layout_verdict", f"""{_EXTENTS} SELECT * FROM (SELECT count(*) AS n_sections, count(DISTINCT image) AS n_images, {', '.join(f"{f}(x_{f}) FILTER (WHERE grp = '{g}') AS {g}_x_{f}" for g in ('control', 'treated') for f in ('min', 'max'))} FROM e),
 (SELECT count(*) AS n_comparisons, bool_and(x_order <> 'overlap') AND count(DISTINCT x_order) = 1 AS consistent, CASE WHEN bool_and(x_order <> 'overlap') AND count(DISTINCT x_order) = 1 THEN min(x_order) END AS "order", count(difference) AS n_known, {_N('difference > 0')} AS n_positive_contrasts, {_N('difference < 0')} AS n_negative_contrasts, {_N('difference > 0')} = count(*) AS all_positive FROM d)""")
def _layout_verdict(v):
    return geometry.layout_verdict(_extents(v))


@query("apart_verdict", f"""{_EXTENTS.replace('min(xmin) AS x_min, max(xmax) AS x_max', "min(xmin + CASE WHEN grp = 'treated' THEN 1e9 ELSE 0 END) AS x_min, max(xmax + CASE WHEN grp = 'treated' THEN 1e9 ELSE 0 END) AS x_max")}
SELECT count(*) AS n_comparisons, bool_and(x_order = 'control lower') AS consistent, min(x_order) AS "order", min(gap) AS least_gap FROM (SELECT *, greatest(low, high, 0) AS gap FROM d)""")
def _apart_verdict(v):
    moved = v.withColumns({c: F.col(c) + F.when(F.col("grp") == "treated", 1e9).otherwise(0) for c in ("xmin", "xmax")})
    extents = _extents(moved)
    gap = geometry.layout_contrasts(extents).agg(F.min("gap").alias("least_gap"))
    return geometry.layout_verdict(extents).select("n_comparisons", "consistent", "order").crossJoin(F.broadcast(gap))


@query("nearest_neighbor", f"{_VX} SELECT a.job, a.object_id, {_r('min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))', 'distance')} FROM w a JOIN w b ON a.job = b.job WHERE a.object_type = 'A' AND b.object_type = 'B' GROUP BY a.job, a.object_id")
def _nearest(v):
    moved = _spread(v)
    found = neighbors.nearest(moved.where(A), moved.where(B))
    return found.groupBy("job", "object_id").agg(F.min("distance").alias("distance"))


_MODEL = cluster.Model(cluster.FEATURES, (-0.5, 0.5), (0.5, 1.0), tuple(((a + 0.5) / 0.5, s - 0.5) for a, s in CENTROIDS), 0.0, 0)
_D = lambda i: f"((la + 0.5e0) / 0.5e0 - ({(CENTROIDS[i][0] + 0.5) / 0.5}e0)) * ((la + 0.5e0) / 0.5e0 - ({(CENTROIDS[i][0] + 0.5) / 0.5}e0)) + ((sh - 0.5e0) / 1.0e0 - ({CENTROIDS[i][1] - 0.5}e0)) * ((sh - 0.5e0) / 1.0e0 - ({CENTROIDS[i][1] - 0.5}e0))"
_K = f"""ok AS (SELECT *, area > 0 AND max_diameter > 0 AND min_diameter >= 0 AND min_diameter <= max_diameter AS valid FROM v WHERE {A}),
 ft AS (SELECT *, CASE WHEN valid THEN log10(area) END AS la, CASE WHEN valid THEN min_diameter / max_diameter END AS sh FROM ok),
 dd AS (SELECT *, {_D(0)} AS d1, {_D(1)} AS d2, {_D(2)} AS d3 FROM ft),
 kk AS (SELECT *, CASE WHEN la IS NULL OR sh IS NULL THEN NULL WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster FROM dd)"""


def _assigned(v):
    return cluster.prepare(v).withColumn("cluster", _MODEL.assign())


@query("cluster_assign", f"{V}, {_K} SELECT job, object_id, cluster FROM kk")
def _assign(v):
    return _assigned(v).select("job", "object_id", "cluster")


@query("cluster_composition", f"""{V}, {_K}, c AS (SELECT arm, grp, animal, cluster, count(*) AS n, {_N('b_present')} AS k FROM kk WHERE cluster IS NOT NULL GROUP BY ALL),
 s AS (SELECT arm, grp, animal, i AS cluster FROM (SELECT DISTINCT arm, grp, animal FROM kk), (SELECT unnest([1, 2, 3]) AS i)), d AS (SELECT arm, grp, animal, cluster, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM s LEFT JOIN c USING (arm, grp, animal, cluster))
SELECT arm, grp, animal, cluster, n, k, {_r('100.0e0 * n / sum(n) OVER (PARTITION BY arm, grp, animal)', 'share_pct')}, {_r(_pct('k', 'n'), 'rate_pct')} FROM d""")
def _composition(v):
    return cluster.composition(_assigned(v), 3)


@query("cluster_profiles", f"{V}, {_K} SELECT arm, cluster, count(*) AS n, {_r('100.0e0 * avg(CAST(min_diameter = 0 AS INT))', 'zero_min_pct')}, {_r('quantile_cont(area, 0.5)', 'median_area')}, {_r('quantile_cont(sh, 0.5)', 'median_shape')}, {_r('quantile_cont(min_diameter, 0.5)', 'median_min_diameter')}, {_r('quantile_cont(max_diameter, 0.5)', 'median_max_diameter')} FROM kk WHERE cluster IS NOT NULL GROUP BY arm, cluster")
def _profiles(v):
    return cluster.profiles(_assigned(v))


@query("cluster_audit", f"""{V}, {_K} SELECT job, count(*) AS n, {_N('valid')} AS n_valid, {_N('NOT valid')} AS n_excluded, {_SHARE('valid', 'retained_pct')}, CAST(0 AS BIGINT) AS unknown_morphology, {_N('area <= 0')} AS nonpositive_area, {_N('max_diameter <= 0')} AS nonpositive_max,
 {_N('min_diameter > max_diameter')} AS min_above_max, {_N('min_diameter < 0')} AS negative_min, {_N('valid AND min_diameter = 0')} AS retained_zero_min, {_N('min_diameter = 0 AND max_diameter = 0')} AS both_zero, {_N('b_present IS NULL')} AS unknown_association, CAST(0 AS BIGINT) AS unknown_places FROM kk GROUP BY job""")
def _cluster_audit(v):
    return cluster.audit(cluster.prepare(v))


#: Exclusion reasons of the odd measurements below, in SQL.
_ODD = "CASE WHEN l_linenumber = 7 THEN 0.0e0 ELSE max_diameter END AS max_diameter, CASE WHEN l_linenumber = 6 AND l_quantity < 25 THEN -1.0e0 WHEN l_linenumber = 7 AND l_quantity < 25 THEN 0.0e0 WHEN l_linenumber = 5 AND l_quantity < 5 THEN NULL ELSE min_diameter END AS min_diameter, CASE WHEN l_linenumber = 4 AND l_quantity < 9 THEN NULL ELSE area END AS area"
_WHY = """concat_ws('; ', CASE WHEN area IS NULL THEN 'unknown area' END, CASE WHEN area <= 0 THEN 'area not positive' END, CASE WHEN min_diameter IS NULL OR max_diameter IS NULL THEN 'unknown diameter' END, CASE WHEN min_diameter = 0 AND max_diameter = 0 THEN 'both diameters zero' END,
  CASE WHEN NOT (min_diameter = 0 AND max_diameter = 0) AND max_diameter <= 0 THEN 'largest diameter not positive' END, CASE WHEN min_diameter < 0 AND max_diameter IS NOT NULL THEN 'negative minimum' END, CASE WHEN min_diameter > max_diameter THEN 'minimum above maximum' END)"""
_EX = f"od AS (SELECT * REPLACE ({_ODD}) FROM v WHERE {A}), ex AS (SELECT *, {_WHY} AS excluded FROM od WHERE NOT coalesce(area > 0 AND max_diameter > 0 AND min_diameter >= 0 AND min_diameter <= max_diameter, false))"


def _odd(v):
    return v.selectExpr(*(c for c in v.columns if c not in ("max_diameter", "min_diameter", "area")), *_ODD.replace(", CASE", "|CASE").split("|"))


@query("exclusions", f"{V}, {_EX} SELECT job, excluded, count(*) AS n FROM ex GROUP BY job, excluded")
def _exclusions(v):
    return cluster.prepare(_odd(v)).where("not valid").groupBy("job", "excluded").agg(F.count("*").alias("n"))


@query("cluster_standardized", f"""{V}, {_K}, s AS (SELECT arm, grp, animal, cluster AS stratum, count(*) AS n, {_N('b_present')} AS k FROM kk WHERE cluster IS NOT NULL GROUP BY ALL), {_CELLS[_CELLS.index('e AS'):].replace('>= 45', '>= 10')}
SELECT arm, grp, animal, {', '.join(_r(c, c) for c in ('raw', 'restricted', 'standardized', 'retained_pct'))} FROM r""")
def _cluster_standardized(v):
    cells = _assigned(v).where("cluster is not null").groupBy("arm", "grp", "animal", "cluster").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    return contrast.standardized(cells, 10, layer="cluster")


@query("adjusted_rand", f"""{V}, {_K}, r AS (SELECT cluster AS a, CASE WHEN la < -0.5e0 THEN 1 ELSE 2 END AS b FROM kk WHERE cluster IS NOT NULL), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY a, b),
 i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT {_r('(i - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2))', 'ari')} FROM i, ra, rb""")
def _ari(v):
    rows = _assigned(v).where("cluster is not null").withColumn("b", F.when(F.col("log_area") < -0.5, 1).otherwise(2))
    return contrast.adjusted_rand(rows, "cluster", "b")


@query("share_grid", f"""{V}, {_K}, w AS (SELECT * REPLACE ((x * 7) % 9973.0e0 AS x) FROM kk), {_grid_sql(WIDTH, 'points')}
SELECT job, ix, iy, count(*) AS n_all, count(cluster) AS n, {_N('cluster IS NULL')} AS n_excluded, {', '.join(_r(f'CASE WHEN count(cluster) >= 10 THEN 100.0e0 * {_N(f"cluster = {c}")} / count(cluster) END', f'pct_{c}') for c in (1, 2, 3))} FROM b GROUP BY job, ix, iy""")
def _shares(v):
    return grid.share_grid(_spread(_assigned(v)), "cluster", (1, 2, 3), WIDTH, 10)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: equal-replicate association, control minus treated, per arm."""
    v = objects(spark, sf_dir).where(A)
    per = v.groupBy("arm", "grp", "animal").agg((100 * F.avg(flag("b_present"))).alias("value"))
    return rounded(contrast.contrast(per.withColumn("metric", F.lit("association_pct"))))


QUERIES["flagship"] = flagship
SQL["flagship"] = SQL["condition_contrast"] + " WHERE metric = 'association_pct'"
