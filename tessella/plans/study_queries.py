"""More queries on the objects view: clustering, grid morphology, neighbourhood, design and review.

As in :mod:`queries`, each runs over the whole table and has an SQL equivalent
where SQL can say it; fits are tested otherwise.
"""

from pyspark.sql import functions as F

from ..functions import percent, polygon_centroid
from ..operators import cluster, contrast, distribution, geometry, grid, morphology, multiset, neighbors, pyramid, summary
from ..sources import normal_path, payload, row_faults
from .design import Design, gate, identity_mismatch, in_display_order, layout_faults, metadata_template, missing_design, review_status, section_metadata
from .queries import DIGITS, _EX, _K, _MODEL, _N, _REP, _RUNS, _VX, QUERIES, SQL, A, B, V, WIDTH, _assigned, _dense, _grid_sql, _long, _odd, _pct, _r, _runs, _spread, query, rounded
from .registration import condition_registration

# --- clustering -------------------------------------------------------------


def _models(v, features=cluster.FEATURES, cap=3000, k=3, keep="valid"):
    """A model of each arm, fitted on its own sample."""
    rows, out = cluster.prepare(v), {}
    rows = rows.where("valid") if keep == "valid" else cluster.area_only(rows)
    for arm in Design().arms:
        out[arm] = rows.where(F.col("arm") == arm), cluster.fit(cluster.balanced_sample(rows.where(F.col("arm") == arm), cap, 20), k, features=features)
    return out


def _centroids(v, models):
    rows = []
    for (arm, k), (_, model) in models.items():
        for i, c in enumerate(model.centroids, 1):
            raw = [float(x * s + m) for x, s, m in zip(c, model.scale, model.center, strict=True)]
            rows.append((arm, k, i, raw[0], raw[1] if len(raw) > 1 else None, model.inertia))
    return v.sparkSession.createDataFrame(rows, "arm string, k int, cluster int, log_area double, shape double, inertia double")


@query("kmeans_fit")
def _kmeans(v):
    return _centroids(v, {(arm, 3): m for arm, m in _models(v).items()}).drop("k")


def _model_rows(v):
    """The models of all arms and variants from one sample of 3,000 rows a replicate."""
    return morphology.fit_models(morphology.ranked_sample(cluster.prepare(v)))


def _clusters_of(models):
    rows = models.select("arm", "variant", "k", "inertia", F.posexplode("raw").alias("_i", "_c"))
    return rows.select("arm", "variant", "k", (F.col("_i") + 1).alias("cluster"), F.get("_c", F.lit(0)).alias("log_area"), F.get("_c", F.lit(1)).alias("shape"), "inertia")


@query("k_sensitivity")
def _k_sensitivity(v):
    return _clusters_of(_model_rows(v).where("kind = 'shape' and left_out is null")).drop("variant")


@query("area_only_fit")
def _area_only_fit(v):
    return _clusters_of(_model_rows(v).where("kind = 'area'")).drop("variant", "k", "shape")


@query("cluster_stability")
def _stability(v):
    got = morphology.run_analysis(v).tables
    jaccard = got["stability_clusters"].groupBy("arm", "left_out").pivot("cluster", [1, 2, 3]).agg(F.first("jaccard"))
    rows = got["stability"].join(jaccard, ["arm", "left_out"])
    return rows.select("arm", F.col("left_out").cast("int").alias("left_out"), "n", "ari", "agreement_pct", *(F.col(str(i)).alias(f"jaccard_{i}") for i in (1, 2, 3)))


@query("fit_audit")
def _fit_audit(v):
    return morphology.run_analysis(v).tables["fit_audit"]


@query("analysis_standardized")
def _analysis_standardized(v):
    return morphology.run_analysis(v).tables["standardized"]


#: Fixed models as rows of the model table: one of all replicates per arm, one without replicate 2, one of area alone.
_FIXED = (("arm1", "k3", "shape", None, 0.0), ("arm2", "k3", "shape", None, 0.1), ("arm1", "without 2", "shape", "2", 0.05), ("arm2", "area", "area", None, 0.2))


def _fixed_sql() -> str:
    parts = []
    for arm, variant, kind, left, move in _FIXED:
        z = "(la + 0.5e0) / 0.5e0"
        s = "" if kind == "area" else " + ((sh - 0.4e0) / 0.8e0 - {})  * ((sh - 0.4e0) / 0.8e0 - {})"
        d = [f"({z} - ({a + move}e0)) * ({z} - ({a + move}e0))" + s.format(f"({b}e0)", f"({b}e0)") for a, b in ((-0.6, -0.2), (0.2, 0.2), (0.6, 2.0))]
        keep = "area > 0" if kind == "area" else "valid" + (f" AND animal = {left}" if left else "")
        parts.append(f"SELECT arm, grp, animal, job, '{variant}' AS variant, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster, b_present, p FROM (SELECT *, {', '.join(f'{x} AS d{i}' for i, x in enumerate(d, 1))} FROM pp WHERE arm = '{arm}' AND {keep})")
    return " UNION ALL ".join(parts)


@query("model_assign", f"""{V}, pa AS (SELECT *, coalesce(area > 0 AND max_diameter > 0 AND min_diameter >= 0 AND min_diameter <= max_diameter, false) AS valid FROM v WHERE {A}),
 pb AS (SELECT *, CASE WHEN area > 0 THEN log10(area) END AS la, CASE WHEN valid THEN min_diameter / max_diameter END AS sh FROM pa),
 pp AS (SELECT *, CASE WHEN valid THEN CASE WHEN e1 <= e2 AND e1 <= e3 THEN 1 WHEN e2 <= e3 THEN 2 ELSE 3 END END AS p FROM (SELECT *, {', '.join(f"((la + 0.5e0) / 0.5e0 - ({a}e0 + CASE WHEN arm = 'arm2' THEN 0.1e0 ELSE 0 END)) * ((la + 0.5e0) / 0.5e0 - ({a}e0 + CASE WHEN arm = 'arm2' THEN 0.1e0 ELSE 0 END)) + ((sh - 0.4e0) / 0.8e0 - ({b}e0)) * ((sh - 0.4e0) / 0.8e0 - ({b}e0)) AS e{i}" for i, (a, b) in enumerate(((-0.6, -0.2), (0.2, 0.2), (0.6, 2.0)), 1))} FROM pb)),
 u AS ({_fixed_sql()})
SELECT arm, grp, animal, job, variant, cluster, CASE WHEN variant LIKE 'without%' THEN p END AS reference, count(*) AS n, {_N('b_present')} AS n_positive, count(b_present) AS n_known FROM u GROUP BY ALL""")
def _model_assign(v):
    rows = []
    for arm, variant, kind, left, move in _FIXED:
        n = 1 if kind == "area" else 2
        places = [[a + move, b][:n] for a, b in ((-0.6, -0.2), (0.2, 0.2), (0.6, 2.0))]
        rows.append((arm, variant, kind, 3, left, list(cluster.FEATURES[:n]), [-0.5, 0.4][:n], [0.5, 0.8][:n], places, places, [], 0, 0, 0.0, 0))
    return morphology.cluster_counts(morphology.assigned(cluster.prepare(v), v.sparkSession.createDataFrame(rows, morphology.MODEL)))


@query("area_only_assign", f"""{V}, a AS (SELECT *, (log10(area) + 0.5e0) / 0.5e0 AS z FROM v WHERE {A} AND area > 0), d AS (SELECT *, (z + 0.6e0) * (z + 0.6e0) AS d1, (z - 0.2e0) * (z - 0.2e0) AS d2, (z - 0.6e0) * (z - 0.6e0) AS d3 FROM a)
SELECT arm, grp, animal, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster, count(*) AS n, {_N('b_present')} AS k FROM d GROUP BY ALL""")
def _area_only_assign(v):
    model = cluster.Model(("log_area",), (-0.5,), (0.5,), ((-0.6,), (0.2,), (0.6,)), 0.0, 0)
    rows = cluster.area_only(cluster.prepare(v)).withColumn("cluster", model.assign())
    return rows.groupBy("arm", "grp", "animal", "cluster").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))


@query("feature_scales", f"""{V}, {_K}, q AS (SELECT arm, {', '.join(f'quantile_cont({c}, {q}) AS {c}{i}, stddev_pop({c}) AS {c}s{i}' for c in ('la', 'sh') for i, q in enumerate((0.25, 0.5, 0.75)))} FROM kk WHERE valid GROUP BY arm)
SELECT arm, {', '.join(f'{_r(f"{c}1", f"{n}_center")}, {_r(f"CASE WHEN {c}2 > {c}0 THEN {c}2 - {c}0 WHEN {c}s0 > 0 THEN {c}s0 ELSE 1.0e0 END", f"{n}_scale")}' for c, n in (('la', 'log_area'), ('sh', 'shape')))} FROM q""")
def _scales(v):
    return cluster.scales(cluster.prepare(v).where("valid"))


@query("balanced_sample", f"""{V}, {_K}, t AS (SELECT least(200, min(n)) AS take FROM (SELECT count(*) AS n FROM kk WHERE valid GROUP BY animal)),
 r AS (SELECT animal, object_id, row_number() OVER (PARTITION BY animal ORDER BY md5('20:' || animal || ':' || object_id), object_id) AS k FROM kk WHERE valid) SELECT animal, object_id FROM r, t WHERE k <= take""")
def _balanced(v):
    return cluster.balanced_sample(cluster.prepare(v).where("valid"), 200, 20).select("animal", "object_id")


@query("display_sample", f"""{V}, {_K}, r AS (SELECT job, object_id, cluster, row_number() OVER (PARTITION BY job ORDER BY md5('20:' || job || ':' || object_id), object_id) AS k FROM kk WHERE cluster IS NOT NULL) SELECT job, object_id, cluster FROM r WHERE k <= 500""")
def _display(v):
    return cluster.display_sample(_assigned(v).where("cluster is not null")).select("job", "object_id", "cluster")


@query("cluster_targets", f"""{V}, {_K}, d AS (SELECT job, cluster, object_id, round(least(d1, d2, d3), 9) AS d FROM kk WHERE cluster IS NOT NULL), q AS (SELECT job, cluster, min(d) AS lo, quantile_cont(d, 0.99) AS hi FROM d GROUP BY job, cluster),
 r AS (SELECT d.job, d.cluster, object_id, d, row_number() OVER (PARTITION BY d.job, d.cluster ORDER BY d, object_id) AS a, row_number() OVER (PARTITION BY d.job, d.cluster ORDER BY round(abs(d - hi), 9), object_id) AS b FROM d JOIN q ON d.job = q.job AND d.cluster = q.cluster)
SELECT job, cluster, 'typical' AS selection, object_id, d FROM r WHERE a = 1 UNION ALL SELECT job, cluster, '99th percentile', object_id, d FROM r WHERE b = 1""")
def _cluster_targets(v):
    return cluster.review_targets(_assigned(v).withColumn("d", F.round(cluster.centroid_distance(_MODEL), 9)), "d")


@query("cluster_contrast", f"""{V}, {_K}, c AS (SELECT arm, grp, animal, cluster, count(*) AS n, {_N('b_present')} AS k FROM kk WHERE cluster IS NOT NULL GROUP BY ALL),
 s AS (SELECT arm, grp, animal, i AS cluster FROM (SELECT DISTINCT arm, grp, animal FROM kk), (SELECT unnest([1, 2, 3]) AS i)),
 d AS (SELECT arm, grp, animal, cluster, 100.0e0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY arm, animal) AS share_pct, {_pct('k', 'n')} AS rate_pct FROM s LEFT JOIN c USING (arm, grp, animal, cluster)),
 l AS (SELECT arm, grp, cluster, 'share_pct' AS metric, share_pct AS value FROM d UNION ALL SELECT arm, grp, cluster, 'rate_pct', rate_pct FROM d),
 m AS (SELECT arm, cluster, metric, {', '.join(f"CASE WHEN count(value) FILTER (WHERE grp = '{g}') = 3 THEN avg(value) FILTER (WHERE grp = '{g}') END AS {n}, count(value) FILTER (WHERE grp = '{g}') AS n{n}" for g, n in (('control', 'a'), ('treated', 'b')))} FROM l GROUP BY ALL)
SELECT arm, cluster, metric, {_r('a', 'control_mean')}, {_r('b', 'treated_mean')}, na AS control_n, nb AS treated_n, {_r('a - b', 'difference')} FROM m""")
def _cluster_contrast(v):
    return contrast.cluster_contrasts(cluster.composition(_assigned(v), 3))


def _greedy(limit: int) -> str:
    """Farthest-point selection unrolled: step k chooses among the k-th reason's rows, or among all that are left."""
    steps, chosen = [], "e0 AS (SELECT DISTINCT job, CAST([] AS STRUCT(p BIGINT, bx BIGINT, byy BIGINT)[]) AS ch FROM cand)"
    for k in range(1, limit + 1):
        away = "coalesce(list_min(list_transform(ch, lambda c: (bx - c.bx) * (bx - c.bx) + (byy - c.byy) * (byy - c.byy))), 0)"
        steps.append(f"""t{k} AS (SELECT cand.*, {away} AS away FROM cand JOIN e{k - 1} USING (job) WHERE (reason_no = {k} OR (reasons < {k} AND NOT list_contains(list_transform(ch, lambda c: c.p), p)))),
 s{k} AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY away DESC, p) AS o FROM t{k}) WHERE o = 1),
 e{k} AS (SELECT e.job, CASE WHEN p IS NULL THEN ch ELSE list_append(ch, {{'p': p, 'bx': bx, 'byy': byy}}) END AS ch FROM e{k - 1} e LEFT JOIN s{k} s USING (job))""")
    return ", ".join([chosen, *steps])


@query("spread_targets", f"""{_VX.replace(' FROM v)', ' FROM v)')}, od AS (SELECT * REPLACE ({_EX.split('REPLACE (')[1].split(') FROM v')[0]}) FROM w WHERE {A}), ex AS (SELECT *, {_EX.split('SELECT *, ')[1].split(' AS excluded')[0]} AS excluded FROM od WHERE NOT coalesce(area > 0 AND max_diameter > 0 AND min_diameter >= 0 AND min_diameter <= max_diameter, false)),
 few AS (SELECT job, excluded, CAST(floor(x / 500.0e0) AS BIGINT) AS bx, CAST(floor(y / 500.0e0) AS BIGINT) AS byy, min(object_id) AS object_id FROM ex GROUP BY ALL),
 cand AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY byy, bx, object_id) AS p, dense_rank() OVER (PARTITION BY job ORDER BY excluded) AS reason_no, (SELECT count(DISTINCT excluded) FROM few g WHERE g.job = few.job) AS reasons FROM few),
 {_greedy(6)}
{' UNION ALL '.join(f'SELECT job, object_id, excluded, bx, byy AS "by", {k} AS place FROM s{k}' for k in range(1, 7))}""")
def _targets(v):
    return cluster.spread_targets(cluster.prepare(_odd(_spread(v))))


# --- grid morphology --------------------------------------------------------

CELL = 500.0


def _shaped(v):
    """Every object moved into an ellipse with a hole and a notch, so that supports have outlines."""
    far = F.pow((F.col("x") - 5000) / 5000, F.lit(2.0)) + F.pow((F.col("y") - 2500) / 2500, F.lit(2.0)) > 1
    v = _spread(v)
    v = v.withColumns({c: F.when(far, m + (F.col(c) - m) * 0.5).otherwise(F.col(c)) for c, m in (("x", 5000), ("y", 2500))})
    off, dy = F.col("x") - 5000 - F.col("job") * 20, F.col("y") - 2500
    v = v.withColumn("x", F.when(off * off + dy * dy <= 810000, F.col("x") + F.when(off >= 0, 2000).otherwise(-2000)).otherwise(F.col("x")))
    return v.withColumn("y", F.when((F.col("x") > 6500 + F.col("job") * 50) & (F.col("y") > 3200), F.col("y") - 1600).otherwise(F.col("y")))


_SHAPED = f"""{_VX}, sa AS (SELECT *, pow((x - 5000) / 5000, 2) + pow((y - 2500) / 2500, 2) > 1 AS far FROM w),
 sb AS (SELECT * REPLACE (CASE WHEN far THEN 5000 + (x - 5000) * 0.5e0 ELSE x END AS x, CASE WHEN far THEN 2500 + (y - 2500) * 0.5e0 ELSE y END AS y) FROM sa),
 sc AS (SELECT * REPLACE (CASE WHEN (x - 5000 - job * 20) * (x - 5000 - job * 20) + (y - 2500) * (y - 2500) <= 810000 THEN x + CASE WHEN x - 5000 - job * 20 >= 0 THEN 2000 ELSE -2000 END ELSE x END AS x) FROM sb),
 sh AS (SELECT * REPLACE (CASE WHEN x > 6500 + job * 50 AND y > 3200 THEN y - 1600 ELSE y END AS y) FROM sc)"""
_SUPPORTED = lambda width: f"{_SHAPED}, {_grid_sql(width, 'closed', 'job', 'sh')}, m0 AS (SELECT DISTINCT job, ix, iy FROM b), o5(dx, dy) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)), o4 AS (SELECT * FROM o5 WHERE dx <> 0 OR dy <> 0)"
_SUPPORT = _SUPPORTED(CELL)


def _dilated(name: str, of: str, bounded: bool = True) -> str:
    inside = " JOIN f USING (job) WHERE ix + dx BETWEEN 0 AND nx - 1 AND iy + dy BETWEEN 0 AND ny - 1" if bounded else ""
    return f"{name} AS (SELECT DISTINCT m.job, m.ix + dx AS ix, m.iy + dy AS iy FROM {of} m CROSS JOIN o5{inside})"


def _eroded(name: str, of: str) -> str:
    return f"{name} AS (SELECT a.job, a.ix, a.iy FROM {of} a CROSS JOIN o5 JOIN {of} z ON z.job = a.job AND z.ix = a.ix + dx AND z.iy = a.iy + dy GROUP BY a.job, a.ix, a.iy HAVING count(*) = 5)"


def _largest(name: str, of: str) -> str:
    """The largest 4-connected part, the first in row order of equals."""
    return f"""{name}_r AS (SELECT job, ix, iy, ix AS rx, iy AS ry FROM {of} UNION SELECT r.job, r.ix, r.iy, z.ix, z.iy FROM {name}_r r CROSS JOIN o4 JOIN {of} z ON z.job = r.job AND z.ix = r.rx + dx AND z.iy = r.ry + dy),
 {name}_l AS (SELECT job, ix, iy, min(ry * 100000 + rx) AS label FROM {name}_r GROUP BY job, ix, iy), {name}_n AS (SELECT job, label, row_number() OVER (PARTITION BY job ORDER BY count(*) DESC, label) AS o FROM {name}_l GROUP BY job, label),
 {name} AS (SELECT l.job, ix, iy FROM {name}_l l JOIN {name}_n n ON l.job = n.job AND l.label = n.label AND o = 1)"""


_VOID = f"""{_SUPPORTED(250.0)}, {_dilated('d1', 'm0')}, {_dilated('d2', 'd1')}, {_eroded('r1', 'd2')}, {_eroded('closed', 'r1')},
 ring AS (SELECT job, nx, ny, unnest(generate_series(-1, nx)) AS ix FROM f), whole AS (SELECT job, ix, unnest(generate_series(-1, ny)) AS iy FROM ring),
 free AS (SELECT job, ix, iy FROM whole ANTI JOIN closed USING (job, ix, iy)),
 out AS (SELECT DISTINCT job, CAST(-1 AS BIGINT) AS ix, CAST(-1 AS BIGINT) AS iy FROM f UNION SELECT z.job, z.ix, z.iy FROM out CROSS JOIN o4 JOIN free z ON z.job = out.job AND z.ix = out.ix + dx AND z.iy = out.iy + dy),
 holes AS (SELECT job, ix, iy FROM free ANTI JOIN out USING (job, ix, iy)), {_largest('hole', 'holes')}, big AS (SELECT job, count(*) AS cells FROM hole GROUP BY job HAVING count(*) >= 6),
 rest AS (SELECT job, ix, iy FROM whole ANTI JOIN hole USING (job, ix, iy)), o8 AS (SELECT a.i AS dx, c.i AS dy FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS i) c WHERE a.i <> 0 OR c.i <> 0),
 away AS (SELECT DISTINCT job, CAST(-1 AS BIGINT) AS ix, CAST(-1 AS BIGINT) AS iy FROM f UNION SELECT z.job, z.ix, z.iy FROM away CROSS JOIN o8 JOIN rest z ON z.job = away.job AND z.ix = away.ix + dx AND z.iy = away.iy + dy),
 edge AS (SELECT h.job, count(*) AS vertices FROM hole h CROSS JOIN o4 JOIN away z ON z.job = h.job AND z.ix = h.ix + dx AND z.iy = h.iy + dy GROUP BY h.job)"""


def _support(v, width=CELL):
    moved = _shaped(v)
    frame = grid.frames(moved, width)
    return grid.cells(moved, width, {"n": F.count("*")}, frame=frame).join(frame.select("job", "x0", "y0"), "job")


@query("candidate_voids", f"{_VOID} SELECT job, cells, vertices FROM big JOIN edge USING (job)")
def _voids(v):
    return geometry.candidate_voids(_support(v, 250.0), 250.0).select("job", "cells", F.size("polygon").cast("long").alias("vertices"))


_CLEAR = f"""ring AS (SELECT job, nx, ny, unnest(generate_series(-1, nx)) AS ix FROM f), whole AS (SELECT job, ix, unnest(generate_series(-1, ny)) AS iy FROM ring), free AS (SELECT job, ix, iy FROM whole ANTI JOIN m0 USING (job, ix, iy)),
 cl AS (SELECT m.job, m.ix, m.iy, sqrt(min((m.ix - z.ix) * (m.ix - z.ix) + (m.iy - z.iy) * (m.iy - z.iy))) * {CELL}e0 - {CELL}e0 * sqrt(2.0e0) / 2 AS clearance FROM m0 m JOIN free z ON z.job = m.job GROUP BY m.job, m.ix, m.iy)"""


@query("clearance", f"{_SUPPORT}, {_CLEAR} SELECT job, ix, iy, {_r('clearance', 'clearance')} FROM cl")
def _clearance(v):
    return geometry.clearances(_support(v), CELL)


def _edges_sql(width: float, tag: str) -> str:
    """Boundary cell centres of the closed support's largest part, on a grid of this width."""
    of = lambda e: f"{e}{tag}"
    frame = _grid_sql(width, "closed", "job", "sh").replace("e AS (", f"{of('e')} AS (").replace(" FROM e)", f" FROM {of('e')})").replace(" f AS (", f" {of('f')} AS (").replace(" JOIN f ", f" JOIN {of('f')} ").replace(" b AS (", f" {of('b')} AS (").replace(" FROM f)", f" FROM {of('f')})").replace(" sp AS (", f" {of('sp')} AS (")
    return f"""{frame}, {of('m')} AS (SELECT DISTINCT job, ix, iy FROM {of('b')}), {_dilated(of('g'), of('m'), False)}, {_eroded(of('h'), of('g'))}, {_largest(of('body'), of('h'))}, {_eroded(of('core'), of('body'))},
 {of('edge')} AS (SELECT k.job, x0 + (ix + 0.5e0) * {width}e0 AS x, y0 + (iy + 0.5e0) * {width}e0 AS y FROM (SELECT * FROM {of('body')} ANTI JOIN {of('core')} USING (job, ix, iy)) k JOIN {of('f')} USING (job))"""


def _aligned_sql(tag: str) -> str:
    """The flip of each section whose boundary lies nearest to that of section 0, about (5000, 2500)."""
    of = lambda e: f"{e}{tag}"
    gap = "sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))"
    one = lambda name, p, q, on: f"{of(name)} AS (SELECT a.job, a.orientation, a.x, a.y, min({gap}) AS d FROM {p} a JOIN {q} c ON {on} GROUP BY ALL), {of(name + 'm')} AS (SELECT job, orientation, avg(d) FILTER (WHERE k <= ceil(0.8e0 * n)) AS m, quantile_cont(d, 0.9) AS t FROM (SELECT *, row_number() OVER (PARTITION BY job, orientation ORDER BY d, x, y) AS k, count(*) OVER (PARTITION BY job, orientation) AS n FROM {of(name)}) GROUP BY job, orientation)"
    return f"""{of('mine')} AS (SELECT job, orientation, place, sx * (x - 5000) AS x, sy * (y - 2500) AS y FROM {of('edge')}, flips WHERE job <> 0), {of('fixed')} AS (SELECT x - 5000 AS x, y - 2500 AS y FROM {of('edge')} WHERE job = 0),
 {of('every')} AS (SELECT j.job, j.orientation, x, y FROM (SELECT DISTINCT job, orientation FROM {of('mine')}) j, {of('fixed')}), {one('ab', of('mine'), of('fixed'), 'true')}, {one('ba', of('every'), of('mine'), 'c.job = a.job AND c.orientation = a.orientation')},
 {of('score')} AS (SELECT p.job, p.orientation, place, (p.m + q.m) / 2 AS score, greatest(p.t, q.t) AS tail FROM {of('abm')} p JOIN {of('bam')} q ON p.job = q.job AND p.orientation = q.orientation JOIN flips ON flips.orientation = p.orientation),
 {of('rank')} AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM {of('score')} WINDOW w AS (PARTITION BY job ORDER BY round(score, 9), place)), {of('best')} AS (SELECT *, (nxt - score) / greatest(nxt, 1.0e0) AS margin FROM {of('rank')} WHERE r = 1)"""


_FLIPS = "flips(orientation, place, sx, sy) AS (VALUES ('none', 0, 1, 1), ('x', 1, -1, 1), ('y', 2, 1, -1), ('both', 3, -1, -1))"
_O5 = "o5(dx, dy) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)), o4 AS (SELECT * FROM o5 WHERE dx <> 0 OR dy <> 0)"


@query("boundaries", f"{_SHAPED}, {_O5}, {_edges_sql(CELL, 'c')} SELECT job, x, y FROM edgec")
def _boundaries(v):
    return geometry.boundaries(_support(v), CELL)


def _proposals(v, width):
    g = _support(v, width)
    centres = g.select("job").distinct().withColumn("cx", F.lit(5000.0)).withColumn("cy", F.lit(2500.0))
    return geometry.alignment_proposals(geometry.boundaries(g, width), centres, 0)


@query("alignment_proposals", f"{_SHAPED}, {_O5}, {_FLIPS}, {_edges_sql(CELL, 'c')}, {_aligned_sql('c')} SELECT job, orientation, {_r('score', 'score')}, {_r('tail', 'tail')}, {_r('margin', 'margin')}, round(margin, 9) < 0.1e0 AS ambiguous, false AS cue_conflict, false AS approved FROM bestc")
def _alignment(v):
    return _proposals(v, CELL)


@query("flip_stability", f"{_SHAPED}, {_O5}, {_FLIPS}, {_edges_sql(CELL, 'c')}, {_aligned_sql('c')}, {_edges_sql(1000.0, 'k')}, {_aligned_sql('k')} SELECT job, a.orientation AS fine, z.orientation AS coarse, a.orientation = z.orientation AS stable FROM bestc a JOIN bestk z USING (job)")
def _flip_stability(v):
    return geometry.stability(_proposals(v, CELL), _proposals(v, 1000.0))


@query("cue_flips", f"""{V}, {_FLIPS}, c AS (SELECT job, CASE WHEN job % 5 <> 0 THEN avg(y) - 2500 - job * 5 END AS dy FROM v GROUP BY job), r AS (SELECT dy AS ref FROM c WHERE job = 1)
SELECT job, orientation, coalesce(dy = 0 OR ref = 0 OR sign(sy * dy) = sign(ref), true) AS allowed FROM c, flips, r""")
def _cue_flips(v):
    cues = v.groupBy("job").agg(F.avg("y").alias("m")).select("job", F.when(F.col("job") % 5 != 0, F.col("m") - 2500 - F.col("job") * 5).alias("dy"))
    flips = v.sparkSession.createDataFrame([(o,) for o in ("none", "x", "y", "both")], "orientation string")
    rows = cues.crossJoin(F.broadcast(flips)).crossJoin(F.broadcast(cues.where("job = 1").select(F.col("dy").alias("ref"))))
    return rows.select("job", "orientation", geometry.allowed_flip("orientation", "dy", "ref").alias("allowed"))


_NOTCHED = "[[x0, y0], [x1, y0], [x1, y1], [x0 + (x1 - x0) / 4, y0 + (y1 - y0) * (0.6e0 + job * 0.01e0)], [x0, y1]]"


@query("notched_centroids", f"""{V}, b AS (SELECT job, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY job), p AS (SELECT job, {_NOTCHED} AS p FROM b),
 e AS (SELECT job, p[i] AS a, p[i % 5 + 1] AS b FROM p, (SELECT unnest(range(1, 6)) AS i)), s AS (SELECT job, a[1] * b[2] - b[1] * a[2] AS c, a[1] + b[1] AS sx, a[2] + b[2] AS sy FROM e)
SELECT job, round(sum(sx * c) / (3 * sum(c)), 6) AS cx, round(sum(sy * c) / (3 * sum(c)), 6) AS cy FROM s GROUP BY job""", digits=6)
def _notched_centroids(v):
    """Concave pentagons that differ from section to section."""
    box = v.groupBy("job").agg(*(f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0 + (x1 - x0) / 4, y0 + (y1 - y0) * (0.6 + F.col("job") * 0.01)), (x0, y1))
    rows = box.select("job", polygon_centroid(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))).alias("c"))
    return rows.select("job", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("polygon_centroids", f"""{V}, p AS (SELECT job, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) + job AS y1 FROM v GROUP BY job)
SELECT job, {_r('(x0 + x1) / 2', 'cx')}, {_r('(y0 + y1) / 2', 'cy')} FROM p""")
def _polygon_centroids(v):
    box = v.groupBy("job").agg(*(f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max)))).withColumn("y1", F.col("y1") + F.col("job"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = box.select("job", polygon_centroid(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))).alias("c"))
    return rows.select("job", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


# --- neighbourhood ----------------------------------------------------------

_NN = f"""nn AS (SELECT a.job, a.object_id, a.x, a.y, min(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))) AS d FROM sh a JOIN sh c ON a.job = c.job WHERE a.object_type = 'A' AND c.object_type = 'B' GROUP BY a.job, a.object_id, a.x, a.y)"""


def _neighbours(v):
    moved = _shaped(v)
    near = neighbors.nearest(moved.where(A), moved.where(B), places=True)
    return neighbors.with_clearance(near, geometry.clearances(_support(v), CELL), grid.frames(moved, CELL), CELL)


_CLEARED = f"{_SUPPORT}, {_CLEAR}, {_NN}, nc AS (SELECT nn.*, clearance FROM nn JOIN f USING (job) JOIN cl ON cl.job = nn.job AND cl.ix = greatest(0, least(CAST(floor((nn.x - x0) / {CELL}e0) AS BIGINT), nx - 1)) AND cl.iy = greatest(0, least(CAST(floor((nn.y - y0) / {CELL}e0) AS BIGINT), ny - 1)))"


@query("interior_neighbors", f"{_CLEARED} SELECT job, object_id, {_r('d', 'distance')}, {_r('clearance', 'clearance')} FROM nc WHERE clearance >= 500 AND d <= clearance")
def _interior(v):
    return neighbors.interior(_neighbours(v), "clearance", 500.0).select("job", "object_id", "distance", "clearance")


@query("proximity_summary", f"""{_CLEARED}, i AS (SELECT *, CASE WHEN clearance >= 500 AND d <= clearance THEN d END AS inn FROM nc)
SELECT job, CAST(job % 6 AS INT) AS animal, count(*) AS n, count(inn) AS n_interior, {_r('quantile_cont(d, 0.5)', 'median_all')}, {_r('quantile_cont(d, 0.95)', 'q95_all')}, {_r('quantile_cont(inn, 0.5)', 'median_interior')}, {_r('100.0e0 * count(inn) / count(*)', 'retained_pct')} FROM i GROUP BY job""")
def _proximity(v):
    keys = summary.unique_keys(v.select("job", "animal").distinct(), "job")
    return neighbors.proximity_summary(_neighbours(v), 500.0).join(F.broadcast(keys), "job")


@query("proximity_curve", f"""{_SHAPED}, {_NN}, p AS (SELECT i, i / 200.0e0 AS probability FROM (SELECT unnest(generate_series(0, 200)) AS i)), s AS (SELECT job, list_sort(list(d)) AS a, count(*) AS n FROM nn GROUP BY job), t AS (SELECT *, (n - 1) * probability AS pos FROM s, p)
SELECT job, {_r('probability', 'probability')}, {_r('a[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (a[CAST(ceil(pos) AS BIGINT) + 1] - a[CAST(floor(pos) AS BIGINT) + 1])', 'value')} FROM t""")
def _proximity_curve(v):
    moved = _shaped(v)
    return distribution.quantile_curve(neighbors.nearest(moved.where(A), moved.where(B)), "distance", ("job",))


# --- design, review, small tables -------------------------------------------

_RAW = "CAST(row_number() OVER (PARTITION BY job ORDER BY object_id) - 1 + CASE WHEN job = 3 THEN 5 ELSE 0 END AS DOUBLE) AS id, CASE WHEN job = 4 AND l_linenumber = 7 THEN ' ' WHEN job = 5 AND l_linenumber = 7 THEN 'other' ELSE 'region ' || job END AS region"


@query("export_checks", f"""{V}, q AS (SELECT *, {_RAW}, CASE WHEN l_linenumber = 7 THEN 'C' ELSE object_type END AS kind FROM v)
SELECT job, count(*) AS n, {_N('intensity IS NULL')} AS unknown_numbers, {_N('id < 0 OR id >= 9007199254740992 OR id <> floor(id)')} AS bad_ids, count(*) - count(DISTINCT id) AS repeated_ids, CAST(0 AS BIGINT) AS odd_flags, {_N("kind NOT IN ('A', 'B')")} AS unknown_classes,
 {_N("trim(region) = ''")} AS blank_region, count(DISTINCT region) - 1 AS more_region, min(region) AS first_region, min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) AS contiguous_ids FROM q GROUP BY job""")
def _export_checks(v):
    v = distribution.numbered(v, "object_id", ("job",))
    number = F.col("number") + F.when(F.col("job") == 3, 5).otherwise(0)
    region = F.when((F.col("job") == 4) & (F.col("l_linenumber") == 7), " ").when((F.col("job") == 5) & (F.col("l_linenumber") == 7), "other").otherwise(F.concat(F.lit("region "), F.col("job").cast("string")))
    kind = F.when(F.col("l_linenumber") == 7, "C").otherwise(F.col("object_type"))
    return row_faults(v.withColumns({"object_id": number.cast("double"), "region": region, "object_type": kind}))


_META = "md AS (SELECT DISTINCT job, animal, grp, arm FROM v)"


def _metadata(v):
    return v.select("job", "animal", "grp", "arm").distinct()


@query("attached_objects", f"{V}, {_META}, o AS (SELECT job, area FROM v) SELECT md.arm, md.grp, md.animal, count(*) AS n, {_r('sum(o.area)', 'area_sum')} FROM o JOIN md ON o.job = md.job GROUP BY md.arm, md.grp, md.animal")
def _attached(v):
    rows = Design().attach(v.select("job", "area"), _metadata(v))
    return rows.groupBy("arm", "grp", "animal").agg(F.count("*").alias("n"), F.sum("area").alias("area_sum"))


_PATHS = (r"C:\Data//Img_", r"c:/DATA\img_")


@query("normalized_paths", rf"""{V}, p AS (SELECT CASE WHEN job % 2 = 0 THEN '{_PATHS[0]}' ELSE '{_PATHS[1]}' END || (job % 3) AS p FROM v)
SELECT regexp_replace(lower(p), '[\\/]+', chr(92) || chr(92), 'g') AS path, count(*) AS n FROM p GROUP BY 1""")
def _paths(v):
    p = F.concat(F.when(F.col("job") % 2 == 0, _PATHS[0]).otherwise(_PATHS[1]), (F.col("job") % 3).cast("string"))
    return v.groupBy(normal_path(p).alias("path")).agg(F.count("*").alias("n"))


@query("combined_exports", f"""{V}, {_META}, u AS (SELECT job, object_type FROM v WHERE arm = 'arm1' UNION ALL SELECT job, object_type FROM v WHERE arm = 'arm2')
SELECT u.job, md.arm, object_type, count(*) AS n FROM u JOIN md ON u.job = md.job GROUP BY u.job, md.arm, object_type""")
def _combined(v):
    parts = [v.where(F.col("arm") == arm).select("job", "object_type", "object_id") for arm in Design().arms]
    whole = parts[0].unionByName(parts[1])
    attributes = summary.unique_keys(v.select("job", "arm").distinct(), "job")
    return whole.join(F.broadcast(attributes), "job").groupBy("job", "arm", "object_type").agg(F.count("*").alias("n"))


@query("design_keys", f"""{V}, {_META}, e AS (SELECT a.animal, m.arm FROM (SELECT DISTINCT animal FROM md) a, (SELECT DISTINCT arm FROM md) m), o AS (SELECT animal, arm FROM md WHERE job <> 4)
SELECT animal, arm, 'missing' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM o) UNION ALL SELECT animal, arm, 'unknown' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM e)""")
def _design_keys(v):
    meta = _metadata(v)
    expected = meta.select("animal").distinct().crossJoin(F.broadcast(meta.select("arm").distinct()))
    return multiset.key_differences(expected, meta.where("job <> 4").select("animal", "arm"))


@query("map_gate", f"""{V}, {_META} SELECT job || ': orientation not reviewed' AS fault FROM md WHERE job % 4 = 1 UNION ALL SELECT '13 records, 12 expected' UNION ALL SELECT 'records and objects name different sections'""")
def _gate(v):
    point = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    yes = {c: F.lit(True) for c in ("landmark_reviewed", "scale_common_confirmed", "support_reviewed", "support_qc")}
    meta = _metadata(v)
    records = meta.unionByName(meta.where("job = 0").withColumn("job", F.lit(60)))
    records = records.withColumns({**yes, "orientation_reviewed": F.col("job") % 4 != 1, "reviewed_polygon": point, "reviewer": F.lit("r"), "second_reviewer": F.lit(""), "orientation": F.lit("none")})
    return v.sparkSession.createDataFrame([(f,) for f in gate(records, v)], "fault string")


#: Five faulty sets of review records, as SQL conditions on (job, animal, grp), and the good one.
_CASES = {"good": None, "few": "11 of 12 section reviews", "twice": "a section has several records", "replicates": "records are not every replicate in every arm", "groups": "groups differ from the recorded assignment", "unreviewed": "11 of 12 sections are approved"}


def _case_rows() -> str:
    return ", ".join(f"('{name}', {'true' if why is None else 'false'}, {dict(few=11, unreviewed=11).get(name, 12)}, {11 if name == 'few' else 12}, '{'reviewed maps, control minus treated; cells that not all replicates support are unknown' if why is None else 'group maps withheld: ' + why}')" for name, why in _CASES.items())


@query("condition_registration", f"""{_VX}, s(review_set, ready, approved, total, message) AS (VALUES {_case_rows()}),
 t AS (SELECT arm, grp, job, b_present, CASE WHEN job % 4 IN (1, 3) THEN -1 ELSE 1 END * (x - 5000.0e0) AS tx, CASE WHEN job % 4 IN (2, 3) THEN -1 ELSE 1 END * (y - 2500.0e0) AS ty FROM w WHERE {A}),
 p AS (SELECT arm, grp, job, CAST(floor((tx + 30000.0e0) / 2000.0e0) AS BIGINT) AS ix, CAST(floor((ty + 30000.0e0) / 2000.0e0) AS BIGINT) AS iy, CASE WHEN count(*) >= 5 THEN 100.0e0 * {_N('b_present')} / count(*) END AS m FROM t GROUP BY ALL),
 m AS (SELECT arm, ix, iy, count(m) FILTER (WHERE grp = 'control') AS nc, count(m) FILTER (WHERE grp = 'treated') AS nt, avg(m) FILTER (WHERE grp = 'control') AS c, avg(m) FILTER (WHERE grp = 'treated') AS t FROM p GROUP BY ALL),
 e AS (SELECT arm, x.x AS ix, y.x AS iy FROM (VALUES ('arm1'), ('arm2')) a(arm), (SELECT unnest(range(0, 30)) AS x) x, (SELECT unnest(range(0, 30)) AS x) y),
 r AS (SELECT e.*, coalesce(nc, 0) AS control_n, coalesce(nt, 0) AS treated_n, CASE WHEN nc = 3 THEN c END AS control_mean, CASE WHEN nt = 3 THEN t END AS treated_mean FROM e LEFT JOIN m USING (arm, ix, iy))
SELECT s.*, arm, ix, iy, control_n, treated_n, {_r('control_mean', 'control_mean')}, {_r('treated_mean', 'treated_mean')}, {_r('control_mean - treated_mean', 'difference')} FROM s LEFT JOIN r ON ready""")
def _condition_registration(v):
    v = _spread(v)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    yes = {c: F.lit(True) for c in ("landmark_reviewed", "orientation_reviewed", "scale_common_confirmed", "support_reviewed", "support_qc")}
    turned = F.element_at(F.array(*map(F.lit, ("none", "x", "y", "both"))), (F.col("job") % 4 + 1).cast("int"))
    good = _metadata(v).withColumns({**yes, "reviewed_polygon": F.array(corner(4000.0, 2000.0), corner(6000.0, 2000.0), corner(6000.0, 3000.0), corner(4000.0, 3000.0)), "reviewer": F.lit("r"), "second_reviewer": F.lit("s"), "orientation": turned})
    at, col = lambda j: F.col("job") == j, F.col
    sets = {
        "good": good,
        "few": good.where("job <> 7"),
        "twice": good.withColumn("job", F.when(at(7), 1).otherwise(col("job"))),
        "replicates": good.withColumn("animal", F.when(at(7), 2).otherwise(col("animal"))),
        "groups": good.withColumn("grp", F.when(at(7), "treated").otherwise(col("grp"))),
        "unreviewed": good.withColumn("support_reviewed", ~at(7)),
    }
    design, out = Design(assignment={i: "control" if i < 3 else "treated" for i in range(6)}), None
    for name, records in sets.items():
        got = condition_registration(v, records, design, 2000.0, 5)
        status = got.status(v.sparkSession).withColumn("review_set", F.lit(name))
        if got.maps is None:
            one = status.withColumns({c: F.lit(None).cast(t) for c, t in (("arm", "string"), *((c, "long") for c in ("ix", "iy", "control_n", "treated_n")), *((c, "double") for c in ("control_mean", "treated_mean", "difference")))})
        else:
            one = F.broadcast(status).crossJoin(got.maps)  # a status is one row
        out = one if out is None else out.unionByName(one)
    return out


@query("design_faults", f"""{V}, {_META}, mm AS (SELECT job, animal, CASE WHEN job = 2 THEN 'treated' ELSE grp END AS grp, arm FROM md WHERE job <> 11 UNION ALL SELECT job, 4, grp, arm FROM md WHERE job = 9),
 g AS (SELECT animal, count(DISTINCT grp) AS k FROM mm GROUP BY animal)
SELECT arm, count(*) AS n_sections, count(*) - count(DISTINCT job) AS repeated_sections, count(*) - count(DISTINCT animal) AS repeated_replicates, {_N("grp = 'control'")} AS n_control, {_N("grp = 'treated'")} AS n_treated, {_N('k > 1')} AS in_two_groups FROM mm JOIN g USING (animal) GROUP BY arm""")
def _design_faults(v):
    meta = _metadata(v)
    odd = meta.where("job <> 11").withColumn("grp", F.when(F.col("job") == 2, "treated").otherwise(F.col("grp")))
    return Design().metadata_faults(odd.unionByName(meta.where("job = 9").withColumn("animal", F.lit(4))))


@query("object_faults", f"""{V}, {_META}, mm AS (SELECT job FROM md WHERE job <> 3 UNION ALL SELECT 77), q AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 'C' ELSE object_type END AS kind, CASE WHEN l_linenumber = 6 THEN -area WHEN l_linenumber <> 5 THEN area END AS size FROM v),
 c AS (SELECT job, count(*) AS n, {_N("kind = 'C'")} AS u, {_N('size < 0')} AS bad FROM q GROUP BY job)
SELECT coalesce(c.job, mm.job) AS job, coalesce(n, 0) AS n, mm.job IS NULL AS not_in_metadata, coalesce(u, 0) AS unknown_classes, coalesce(bad, 0) AS bad_areas FROM c FULL JOIN mm ON c.job = mm.job""")
def _object_faults(v):
    line = F.col("l_linenumber")
    odd = v.withColumns({"object_type": F.when(line == 7, "C").otherwise(F.col("object_type")), "area": F.when(line == 6, -F.col("area")).when(line != 5, F.col("area"))})
    meta = _metadata(v)
    return Design().object_faults(odd, meta.where("job <> 3").unionByName(meta.where("job = 0").withColumn("job", F.lit(77))))


@query("layout_faults", f"""{V}, {_META}, im AS (SELECT *, 'image ' || animal AS image_id, CASE WHEN job = 8 THEN ' ' WHEN job = 4 THEN 'other' ELSE 'Image ' || animal END AS image_label FROM md), n AS (SELECT image_id, count(DISTINCT image_label) AS n_labels FROM im GROUP BY image_id),
 c AS (SELECT job, CAST(0 AS BIGINT) AS unknown_boxes, {_N('xmin > xmax OR ymin > ymax')} AS reversed_boxes, CAST(0 AS BIGINT) AS unknown_classes FROM v GROUP BY job)
SELECT c.*, n_labels, trim(image_label) = '' AS blank_identity FROM c JOIN im USING (job) JOIN n USING (image_id)""")
def _layout_faults(v):
    label = F.when(F.col("job") == 8, " ").when(F.col("job") == 4, "other").otherwise(F.concat(F.lit("Image "), F.col("animal").cast("string")))
    return layout_faults(v, _metadata(v).withColumns({"image_id": F.concat(F.lit("image "), F.col("animal").cast("string")), "image_label": label}))


@query("identity_mismatch", f"""{V}, {_META}, o AS (SELECT job, CASE WHEN job = 6 THEN 1 ELSE animal END AS animal, CASE WHEN job IN (6, 7) THEN 'other' ELSE grp END AS grp FROM md WHERE job > 0)
SELECT job, 'animal' AS field FROM md JOIN o USING (job) WHERE md.animal <> o.animal UNION ALL SELECT job, 'grp' FROM md JOIN o USING (job) WHERE md.grp <> o.grp UNION ALL SELECT job, 'job' FROM md ANTI JOIN o USING (job)""")
def _identity(v):
    meta = _metadata(v)
    other = meta.where("job > 0").withColumns({"animal": F.when(F.col("job") == 6, 1).otherwise(F.col("animal")), "grp": F.when(F.col("job").isin(6, 7), "other").otherwise(F.col("grp"))})
    return identity_mismatch(meta, other, ("animal", "grp"))


@query("section_metadata", f"""{V}, s AS (SELECT job, CASE WHEN job % 6 < 3 THEN 'home' ELSE 'wheel' END AS condition, CASE WHEN job < 6 THEN 'k' ELSE 'p' END AS marker, CASE WHEN job = 11 THEN 'interrupted_superseded' WHEN job = 10 THEN 'primary_replacement' ELSE 'primary' END AS status, count(*) AS n FROM v GROUP BY job)
SELECT job, CASE condition WHEN 'home' THEN 'control' ELSE 'treated' END AS grp, CASE marker WHEN 'k' THEN 'arm1' ELSE 'arm2' END AS arm, n AS rows FROM s WHERE status <> 'interrupted_superseded'""")
def _section_metadata(v):
    job = F.col("job")
    status = F.when(job == 11, "interrupted_superseded").when(job == 10, "primary_replacement").otherwise("primary")
    manifest = v.groupBy("job").agg(F.count("*").alias("rows")).withColumns({"condition": F.when(job % 6 < 3, "home").otherwise("wheel"), "marker": F.when(job < 6, "k").otherwise("p"), "duplicate_status": status})
    return section_metadata(manifest, {"home": "control", "wheel": "treated"}, {"k": "arm1", "p": "arm2"}).select("job", "grp", "arm", "rows")


@query("missing_design", f"""{V}, {_META} SELECT job, concat_ws(', ', 'sex', CASE WHEN job % 2 = 0 THEN 'age' END, CASE WHEN job % 3 = 0 THEN 'notes' END) AS missing FROM md""")
def _missing_design(v):
    blank = metadata_template(_metadata(v), fields=("sex", "age", "notes"))
    filled = blank.withColumns({"age": F.when(F.col("job") % 2 != 0, "9").otherwise(" "), "notes": F.when(F.col("job") % 3 != 0, "seen")})
    return missing_design(filled, ("sex", "age", "notes"))


@query("review_status", f"""{V}, {_META}, r AS (SELECT job, job % 2 = 0 AS marked, job % 3 <> 0 AS oriented, job <> 5 AS scaled, job <> 7 AS sup, CASE WHEN job <> 8 THEN 'r' ELSE ' ' END AS reviewer, CASE WHEN job IN (2, 4, 10) THEN 'x' ELSE 'none' END AS orientation, CASE WHEN job = 2 THEN 's' WHEN job = 4 THEN 'r' ELSE '' END AS second FROM md),
 w AS (SELECT job, concat_ws('; ', CASE WHEN NOT marked THEN 'landmark not reviewed' END, CASE WHEN NOT oriented THEN 'orientation not reviewed' END, CASE WHEN NOT scaled THEN 'scale not confirmed' END, CASE WHEN NOT sup THEN 'support not approved' END, CASE WHEN trim(reviewer) = '' THEN 'no reviewer' END, CASE WHEN orientation <> 'none' AND (second = '' OR second = reviewer) THEN 'flip needs a second reviewer' END) AS reasons FROM r)
SELECT job, reasons = '' AS ready, reasons FROM w""")
def _review_status(v):
    job, point = F.col("job"), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    records = _metadata(v).withColumns({
        "reviewed_polygon": point, "landmark_reviewed": job % 2 == 0, "orientation_reviewed": job % 3 != 0, "scale_common_confirmed": job != 5, "support_reviewed": job != 7, "support_qc": F.lit(True),
        "reviewer": F.when(job != 8, "r").otherwise(" "), "orientation": F.when(job.isin(2, 4, 10), "x").otherwise("none"), "second_reviewer": F.when(job == 2, "s").when(job == 4, "r").otherwise(""),
    })
    return review_status(records)


@query("strict_contrast", f"""{V}, {_REP}, o AS (SELECT arm, metric, grp, animal, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS m FROM l WINDOW w AS (PARTITION BY arm, metric, grp)),
 d AS (SELECT a.arm, a.metric, min(b.m - a.m) AS low, max(b.m - a.m) AS high FROM o a JOIN o b ON a.arm = b.arm AND a.metric = b.metric AND a.grp = 'control' AND b.grp = 'treated' GROUP BY a.arm, a.metric),
 m AS (SELECT arm, metric, avg(value) FILTER (WHERE grp = 'control') AS a, avg(value) FILTER (WHERE grp = 'treated') AS b FROM l GROUP BY arm, metric)
SELECT arm, metric, {_r('a', 'control_mean')}, {_r('b', 'treated_mean')}, {_r('b - a', 'difference')}, {_r('low', 'low')}, {_r('high', 'high')} FROM m JOIN d USING (arm, metric)""")
def _strict(v):
    return contrast.strict_contrast(_long(v))


@query("run_totals", f"""{V}, r AS (SELECT {_RUNS} FROM v) SELECT pair, object_type, {_N("run = 'first'")} AS n_first, {_N("run = 'second'")} AS n_second, {_N("run = 'second'")} - {_N("run = 'first'")} AS change FROM r GROUP BY pair, object_type""")
def _totals(v):
    return multiset.run_totals(_runs(v), "run", ("first", "second"), "pair")


@query("display_order", f"{V}, c AS (SELECT animal, count(*) AS n FROM v GROUP BY animal) SELECT animal, n, CASE animal WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS display_order FROM c")
def _display_order(v):
    return in_display_order(v.groupBy("animal").agg(F.count("*").alias("n")), "animal", (3, 1, 5))


@query("window_objects", f"{_VX} SELECT job, object_id FROM w WHERE x BETWEEN 1000 AND 2500 AND y BETWEEN 900 AND 2000")
def _window(v):
    return grid.points_in_window(_spread(v), 1000.0, 2500.0, 900.0, 2000.0).select("job", "object_id")


@query("box_midpoints", f"{V} SELECT job, object_id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM v")
def _midpoints(v):
    return v.select("job", "object_id", "x", "y")


@query("supported_share", f"{_VX}, {_grid_sql(WIDTH, 'zero')}, c AS (SELECT job, ix, iy, {_N(A)} AS n_a FROM b GROUP BY job, ix, iy) SELECT job, count(*) AS occupied, {_N('n_a >= 10')} AS supported, {_r('100.0e0 * ' + _N('n_a >= 10') + ' / count(*)', 'supported_pct')} FROM c WHERE n_a > 0 GROUP BY job")
def _supported(v):
    return grid.supported_share(grid.fraction_grid(_spread(v), WIDTH, 10, "zero"))


@query("shown_cells", f"{_VX}, {_grid_sql(WIDTH, 'zero')}, {_dense('job', {'n_a': _N(A), 'n_b': _N(B)})} SELECT job, ix, iy, {_r('CASE WHEN n_a >= 10 THEN -ln(1 + n_b) END', 'shown')} FROM g")
def _shown(v):
    g = grid.fraction_grid(_spread(v), WIDTH, 10, "zero")
    return grid.shown_cells(g, "n_b", 10, log=True, reverse=True).select("job", "ix", "iy", "shown")


_PADDED = _grid_sql(WIDTH, "closed").replace("floor(x_lo / 1000.0e0) * 1000.0e0", "(floor(x_lo / 1000.0e0) - 2) * 1000.0e0").replace("floor(y_lo / 1000.0e0) * 1000.0e0", "(floor(y_lo / 1000.0e0) - 2) * 1000.0e0")
for _c in "xy":
    _PADDED = _PADDED.replace(f"CAST(greatest(ceil({_c}_hi / 1000.0e0) - floor({_c}_lo / 1000.0e0), 1) AS BIGINT)", f"CAST(ceil({_c}_hi / 1000.0e0) - floor({_c}_lo / 1000.0e0) + 4 AS BIGINT)")


@query("padded_grid", f"{_VX}, {_PADDED}, {_dense('job', {'n': 'count(*)'})} SELECT job, ix, iy, n FROM g")
def _padded(v):
    moved = _spread(v)
    return grid.cells(moved, WIDTH, {"n": F.count("*")}, "padded", frame=grid.frames(moved, WIDTH, "padded", pad=2))


@query("condition_payload", f"""{V}, c AS (SELECT arm, grp, count(*) AS n, CASE WHEN grp = 'control' THEN round(100.0e0 * {_N('b_present')} / count(*), 2) END AS pct FROM v GROUP BY arm, grp)
SELECT CAST(to_json({{'arm': arm, 'grp': grp, 'n': n, 'pct': pct}}) AS VARCHAR) AS json FROM c""")
def _payload(v):
    rows = v.groupBy("arm", "grp").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if("b_present") / F.count("*"), 2).alias("pct"))
    return payload(rows.withColumn("pct", F.when(F.col("grp") == "control", F.col("pct")).otherwise(F.lit(float("nan")))))


def _level_sql(width: int) -> str:
    """Cells of one width, counted from the objects."""
    return f"""SELECT job, {width}.0e0 AS width, ix, iy, count(*) FILTER (WHERE object_type = 'A') AS n_a, count(*) FILTER (WHERE object_type = 'B') AS n_b, count(*) FILTER (WHERE object_type = 'A' AND b_present) AS n_positive, count(*) AS n_all,
 coalesce(sum(area) FILTER (WHERE object_type = 'A'), 0) AS area_a, count(*) FILTER (WHERE object_type = 'A' AND area >= 1) AS n_large, coalesce(sum(overlap_area) FILTER (WHERE object_type = 'A'), 0) AS overlap_area
 FROM (SELECT w.*, CAST(least(floor((x - x0) / {width}), nx - 1) AS BIGINT) AS ix, CAST(least(floor((y - y0) / {width}), ny - 1) AS BIGINT) AS iy FROM w JOIN f{width} USING (job)) GROUP BY ALL"""


def _frame_sql(width: int) -> str:
    return f"""f{width} AS (SELECT job, floor(min(x) / {width}) * {width} AS x0, floor(min(y) / {width}) * {width} AS y0, CAST(greatest(ceil(max(x) / {width}) - floor(min(x) / {width}), 1) AS BIGINT) AS nx, CAST(greatest(ceil(max(y) / {width}) - floor(min(y) / {width}), 1) AS BIGINT) AS ny FROM w GROUP BY job),
 s{width} AS (SELECT job, {width}.0e0 AS width, x0, y0, ix, iy FROM (SELECT *, unnest(range(0, nx)) AS ix FROM f{width}) JOIN (SELECT job, unnest(range(0, ny)) AS iy FROM f{width}) USING (job))"""


#: Widths of the pyramid; 750 nests in 250 and not in 500.
_FINE, _LEVELS = 250, (500, 750, 2000)


@query("section_payload", f"""{_VX}, {', '.join(_frame_sql(w) for w in (_FINE, *_LEVELS))}, s AS ({' UNION ALL '.join(f'SELECT * FROM s{w}' for w in (_FINE, *_LEVELS))}), c AS ({' UNION ALL '.join(_level_sql(w) for w in (_FINE, *_LEVELS))})
SELECT job, job < 6 AS ready, CASE WHEN job < 6 THEN 'x' END AS orientation, width, ix, iy, x0 + (ix + 0.5e0) * width AS x, y0 + (iy + 0.5e0) * width AS y, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_positive, 0) AS n_positive,
 CASE WHEN width > {_FINE} THEN coalesce(n_all, 0) END AS n_all, CASE WHEN width > {_FINE} THEN round(coalesce(area_a, 0), {DIGITS}) END AS area_a, CASE WHEN width > {_FINE} THEN coalesce(n_large, 0) END AS n_large, CASE WHEN width > {_FINE} THEN round(coalesce(overlap_area, 0), {DIGITS}) END AS overlap_area
FROM s LEFT JOIN c USING (job, width, ix, iy)""")
def _section_payload(v):
    meta = _metadata(v)
    reviews = meta.select("job", (F.col("job") < 6).alias("ready"), F.array(F.lit(1.0), F.lit(2.0)).alias("center"), F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("polygon"), F.lit("x").alias("orientation"))
    made = pyramid.section_payload(_spread(v), meta, _LEVELS, _FINE, reviews)
    # Read back from the JSON, cell by cell.
    matrix = lambda names: ", ".join(f"{n}: ARRAY<ARRAY<{'DOUBLE' if 'area' in n else 'BIGINT'}>>" for n in names)
    grid_type = lambda names: f"STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>, width: DOUBLE, {matrix(names)}>"
    layers = (*pyramid.BASIC, *pyramid.MORE)
    schema = f"job INT, ready BOOLEAN, reviewed_orientation STRING, fine {grid_type(layers)}, grids STRUCT<{', '.join(f'`{w}`: {grid_type(layers)}' for w in _LEVELS)}>"
    read = made.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("p")).select("p.job", "p.ready", F.col("p.reviewed_orientation").alias("orientation"), F.explode(F.array("p.fine", *(f"p.grids.`{w}`" for w in _LEVELS))).alias("g"))
    rows = read.select("job", "ready", "orientation", "g", F.posexplode("g.y").alias("iy", "y")).select("*", F.posexplode("g.x").alias("ix", "x"))
    at = lambda n: F.get(F.get(F.col(f"g.{n}"), F.col("iy")), F.col("ix")).alias(n)
    return rows.select("job", "ready", "orientation", "g.width", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "x", "y", *map(at, layers))


# --- another table with the same design ----------------------------------------

_EVENTS = """SELECT CAST(user_id % 12 AS INT) AS job, CAST(user_id % 6 AS INT) AS animal, CASE WHEN user_id % 12 < 6 THEN 'arm1' ELSE 'arm2' END AS arm, CASE WHEN user_id % 6 < 3 THEN 'control' ELSE 'treated' END AS grp,
  event_id AS object_id, CASE WHEN event_type IN ('view', 'click') THEN 'A' ELSE 'B' END AS object_type, value AS area, value * (event_id % 5) / 5.0e0 AS overlap_area, event_id % 3 = 0 AS b_present FROM {events}"""
_E = f"WITH v AS ({_EVENTS.format(events='events')})"


def _events(spark, sf_dir):
    return spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _event_query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = lambda spark, sf_dir: rounded(f(_events(spark, sf_dir))), sql
        return f

    return add


@_event_query("event_contrast", f"""{_E}, {_REP}, m AS (SELECT arm, metric, avg(value) FILTER (WHERE grp = 'control') AS a, avg(value) FILTER (WHERE grp = 'treated') AS b, {_N("grp = 'control'")} AS na, {_N("grp = 'treated'")} AS nb FROM l GROUP BY arm, metric)
SELECT arm, metric, {_r('a', 'control_mean')}, {_r('b', 'treated_mean')}, na AS control_n, nb AS treated_n, {_r('a - b', 'difference')} FROM m""")
def _event_contrast(v):
    return contrast.contrast(_long(v))


@_event_query("event_quantiles", f"""{_E}, p AS (SELECT unnest([0.0e0, 0.25e0, 0.5e0, 0.75e0, 1.0e0]) AS probability)
SELECT job, object_type, probability, {_r("quantile_cont(area, [0.0, 0.25, 0.5, 0.75, 1.0])[CAST(probability * 4 AS INT) + 1]", 'value')} FROM v, p GROUP BY job, object_type, probability""")
def _event_quantiles(v):
    return distribution.quantile_curve(v, "area", ("job", "object_type"), 5)


@_event_query("event_overlap", f"{_E} SELECT job, object_type, count(*) AS n, {_r('100.0e0 * sum(overlap_area) / sum(area)', 'overlap_pct')} FROM v GROUP BY job, object_type")
def _event_overlap(v):
    return v.groupBy("job", "object_type").agg(F.count("*").alias("n"), percent(F.sum("overlap_area"), F.sum("area")).alias("overlap_pct"))
