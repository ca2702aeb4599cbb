"""The jobs as queries: each runs its job twice into a new folder of the shared store and returns what the job left there."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import queries as plans

from . import condition_report, text_intake
from .common import config_of, stored


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, one of this machine, which must be the only one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessella-jobs-')}"
    return f"{base.rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def job1_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and section reports of the intake of ``documents``, told apart by ``record``."""
    at = _folder(spark, "text_intake")
    config = config_of(text_intake.CONFIG, input=f"{sf_dir}/documents.parquet", output=f"{at}/output", checkpoint=f"{at}/checkpoint")
    for _ in range(2):
        text_intake.run(spark, config)
    rows = stored(spark, f"{at}/output/rows", text_intake.ROWS).withColumn("record", F.lit("row"))
    reports = stored(spark, f"{at}/output/sections", text_intake.section_schema(config["word_edges"], config["quantiles"])).withColumn("record", F.lit("section"))
    return plans.rounded(rows.unionByName(reports, allowMissingColumns=True))


def job2_condition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the condition report, one row per measure: ``(report, arm, entity, measure, value)``."""
    at = _folder(spark, "condition_report")
    config = config_of(condition_report.CONFIG, input=f"{sf_dir}/lineitem.parquet", output=at)
    for _ in range(2):
        condition_report.run(spark, config)
    out = None
    for name, keys in _KEYS.items():
        rows = spark.read.parquet(f"{at}/{name}")
        measures = [c for c, t in rows.dtypes if c not in (*keys, "arm")]
        entity = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
        one = rows.select("arm", entity.alias("entity"), *(F.col(c).cast("double").alias(c) for c in measures)).unpivot(["arm", "entity"], measures, "measure", "value").withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return plans.rounded(out)


QUERIES = {f.__name__: f for f in (job1_text_intake, job2_condition_report)}

#: Key columns of each table, besides the arm.
_KEYS = {"quality": ("job",), "sections": ("job", "object_type"), "replicates": ("grp", "animal"), "contrasts": ("metric",)}

_JOB1 = r"""
WITH t AS (SELECT doc_id, text, n_chars AS stated, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'und' ELSE lang END AS lang, CASE WHEN trim(coalesce(source, '')) = '' THEN 'und' ELSE source END AS source,
  trim(coalesce(lang, '')) = '' AS no_lang, trim(coalesce(source, '')) = '' AS no_source, length(text) AS c, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents),
r AS (SELECT doc_id, source, lang, sha256(text) AS text_sha256, strlen(text) AS n_bytes, c AS n_chars, w AS n_words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, stated AS stated_chars,
  CASE WHEN w >= 2000 THEN 4 WHEN w >= 500 THEN 3 WHEN w >= 100 THEN 2 WHEN w >= 20 THEN 1 WHEN w >= 0 THEN 0 END AS stratum,
  concat_ws('; ', CASE WHEN doc_id IS NULL THEN 'no id' END, CASE WHEN text IS NULL THEN 'no text' END, CASE WHEN w = 0 THEN 'empty text' END, CASE WHEN no_lang THEN 'no language' END, CASE WHEN no_source THEN 'no source' END,
    CASE WHEN stated IS DISTINCT FROM c THEN 'length differs' END, CASE WHEN w > 0 AND w < 20 THEN 'few words' END) AS faults FROM t),
d AS (SELECT lang, source, count(*) AS n_texts, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_repeated FROM (SELECT lang, source, text_sha256, count(*) AS n FROM r WHERE text_sha256 IS NOT NULL GROUP BY ALL) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_words DESC) AS place, count(n_words) OVER (PARTITION BY lang, source) AS known FROM r),
s AS (SELECT lang, source, count(*) AS n_documents, count(*) FILTER (WHERE faults <> '') AS n_faulty,
  count(*) FILTER (WHERE doc_id IS NULL) AS n_no_id, count(*) FILTER (WHERE text_sha256 IS NULL) AS n_no_text, count(*) FILTER (WHERE n_words = 0) AS n_empty_text, count(*) FILTER (WHERE faults LIKE '%no language%') AS n_no_language, count(*) FILTER (WHERE faults LIKE '%no source%') AS n_no_source,
  count(*) FILTER (WHERE stated_chars IS DISTINCT FROM n_chars) AS n_length_differs, count(*) FILTER (WHERE n_words BETWEEN 1 AND 19) AS n_few_words,
  CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(n_words), 0) AS BIGINT) AS n_words,
  count(*) FILTER (WHERE stratum = 0) AS n_stratum_0, count(*) FILTER (WHERE stratum = 1) AS n_stratum_1, count(*) FILTER (WHERE stratum = 2) AS n_stratum_2, count(*) FILTER (WHERE stratum = 3) AS n_stratum_3, count(*) FILTER (WHERE stratum = 4) AS n_stratum_4,
  quantile_cont(CAST(n_words AS DOUBLE), 0.25) AS words_p25, quantile_cont(CAST(n_words AS DOUBLE), 0.5) AS words_p50, quantile_cont(CAST(n_words AS DOUBLE), 0.75) AS words_p75, quantile_cont(CAST(n_words AS DOUBLE), 0.99) AS words_p99,
  CASE WHEN sum(n_words) > 0 THEN 100.0e0 * sum(n_words) FILTER (WHERE place <= greatest(1, ceil(0.01e0 * known))) / sum(n_words) END AS top_share_pct FROM k GROUP BY lang, source),
l AS (SELECT lang, sum(n_words) AS words FROM r GROUP BY lang)
SELECT 'row' AS record, lang, source, doc_id, text_sha256, n_bytes, n_chars, CAST(n_words AS BIGINT) AS n_words, CAST(n_lines AS BIGINT) AS n_lines, stated_chars, CAST(stratum AS INT) AS stratum, faults, CAST(0 AS BIGINT) AS batch,
  n_documents, n_faulty, n_no_id, n_no_text, n_empty_text, n_no_language, n_no_source, n_length_differs, n_few_words, n_stratum_0, n_stratum_1, n_stratum_2, n_stratum_3, n_stratum_4, n_texts, n_repeated, words_p25, words_p50, words_p75, words_p99, top_share_pct, words_pct, through_batch
FROM (SELECT r.*, s.* EXCLUDE (lang, source, n_bytes, n_chars, n_words), d.* EXCLUDE (lang, source), CAST(NULL AS DOUBLE) AS words_pct, CAST(NULL AS BIGINT) AS through_batch FROM r LEFT JOIN s ON false LEFT JOIN d ON false)
UNION ALL BY NAME
SELECT 'section' AS record, s.* EXCLUDE (words_p25, words_p50, words_p75, words_p99, top_share_pct), round(words_p25, 9) AS words_p25, round(words_p50, 9) AS words_p50, round(words_p75, 9) AS words_p75, round(words_p99, 9) AS words_p99, round(top_share_pct, 9) AS top_share_pct,
  coalesce(n_texts, 0) AS n_texts, coalesce(n_repeated, 0) AS n_repeated, CASE WHEN words > 0 THEN round(100.0e0 * s.n_words / words, 9) END AS words_pct, CAST(0 AS BIGINT) AS through_batch
FROM s LEFT JOIN d ON s.lang = d.lang AND s.source = d.source JOIN l ON s.lang = l.lang
"""


def _job2() -> str:
    v, arm = plans.V, "CASE WHEN job < 6 THEN 'arm1' ELSE 'arm2' END"
    own = plans.SQL["quality_control"].replace(plans.V, "")
    for gone in ("animal", "arm", "grp", "l_quantity", "l_linenumber", "l_orderkey"):  # columns that the report's objects do not have
        own = own.replace(f"count(*) - count({gone}) + ", "")
    rest = lambda name: plans.SQL[name].replace(f"{v} ", "", 1).replace(f"{v}, ", "WITH RECURSIVE ", 1)
    wide = f"r AS (SELECT arm, grp, animal, association_pct, mean_area, area_overlap_pct FROM ({rest('replicate_metrics')})), z AS ({rest('size_standardized')})"
    metrics = ("association_pct", "mean_area", "area_overlap_pct", "restricted", "standardized")
    values = " UNION ALL ".join(f"SELECT r.arm, r.grp, r.animal, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM r JOIN z ON r.arm = z.arm AND r.grp = z.grp AND r.animal = z.animal" for m in metrics)
    long = f"{wide}, l AS ({values})"
    back = lambda name: plans.SQL[name].replace(f"{v}, {plans._REP}", f"WITH RECURSIVE {long}")
    unpivot = lambda report, body, keys, entity: f"SELECT '{report}' AS report, arm, {entity} AS entity, measure, value FROM (UNPIVOT (SELECT arm, {', '.join(keys)}, CAST(COLUMNS(* EXCLUDE (arm, {', '.join(keys)})) AS DOUBLE) FROM ({body})) ON COLUMNS(* EXCLUDE (arm, {', '.join(keys)})) INTO NAME measure VALUE value)"
    parts = (
        unpivot("quality", f"SELECT q.*, s.* EXCLUDE (job), {arm.replace('job', 'q.job')} AS arm FROM ({own}) q JOIN ({rest('run_summary')}) s ON q.job = s.job", ("job",), "CAST(job AS VARCHAR)"),
        unpivot("sections", f"SELECT *, {arm} AS arm FROM ({rest('object_summary')})", ("job", "object_type"), "concat_ws('/', CAST(job AS VARCHAR), object_type)"),
        unpivot("replicates", f"SELECT m.*, s.* EXCLUDE (arm, grp, animal) FROM ({rest('replicate_metrics')}) m JOIN ({rest('size_standardized')}) s ON m.arm = s.arm AND m.grp = s.grp AND m.animal = s.animal", ("grp", "animal"), "concat_ws('/', grp, CAST(animal AS VARCHAR))"),
        unpivot("contrasts", f"SELECT c.*, p.* EXCLUDE (arm, metric), e.* EXCLUDE (arm, metric, observed_difference) FROM ({back('condition_contrast')}) c JOIN ({back('leave_pair_out')}) p ON c.arm = p.arm AND c.metric = p.metric JOIN ({back('exact_allocation')}) e ON c.arm = e.arm AND c.metric = e.metric", ("metric",), "metric"),
    )
    return f"{v} " + " UNION ALL ".join(parts)


ORACLE_SQL = {"job1_text_intake": _JOB1, "job2_condition_report": _job2()}
