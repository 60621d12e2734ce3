"""Checked queries for the results log (R1–R7) on the ``results_fx``
fixture: 1 row per order, repeated keys, many dates, malformed metrics
JSON (1 in 97), a missing metric (1 in 10), NaN (1 in 13) and parameters
that differ only in their text (1.0 and 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import results as R
from cadenza.plans.registry import ORACLE, register, rounded
from cadenza.session import scratch_path
from cadenza.sources.fixtures import view, with_views

_NAMES = ("ndcg_at_5", "precision_at_5")


def _log(spark, d):
    return view(spark, d, "results_fx")


def _prefix():
    return with_views("SELECT 1", ["results_fx"]).rsplit("\nSELECT 1", 1)[0]


# NaN counts as missing
_VALID = "CASE WHEN metrics <> 'not json' THEN replace(metrics, 'NaN', 'null') END"
_EXPANDED = f"""
expanded AS (SELECT *, round(TRY_CAST(json_extract_string({_VALID}, '$.ndcg_at_5') AS DOUBLE), 6) AS ndcg_at_5,
                    round(TRY_CAST(json_extract_string({_VALID}, '$.precision_at_5') AS DOUBLE), 6) AS precision_at_5
             FROM results_fx)"""
_SUMMARY = """
summary AS (SELECT *, concat('alpha=', CASE WHEN regexp_matches(json_extract_string(param, '$.alpha'), '^[0-9]+$')
                                 THEN json_extract_string(param, '$.alpha')
                                 ELSE printf('%.2f', CAST(json_extract_string(param, '$.alpha') AS DOUBLE)) END,
                             ', factors=', json_extract_string(param, '$.factors')) AS param_summary
            FROM expanded)"""


@register("read_results", "SELECT * FROM results_fx", ("results_fx",))
def q_read_results(spark, d):
    """S3: the log as an existing CSV file, read back."""
    path = scratch_path(spark, "results")
    R.write_results_csv(_log(spark, d), path)
    return R.read_results_csv(spark, path, order_col="seq")


@register("metric_names", f"""
SELECT DISTINCT unnest(json_keys({_VALID})) AS metric FROM results_fx""", ("results_fx",))
def q_metric_names(spark, d):
    return R.metric_names(_log(spark, d))


@register("expand_metrics", f", {_EXPANDED.strip()}\nSELECT * FROM expanded")
def q_expand(spark, d):
    return rounded(R.expand_metrics(_log(spark, d)), *_NAMES)


@register("results_summary", f", {_EXPANDED.strip()}, {_SUMMARY.strip()}\nSELECT * FROM summary")
def q_summary(spark, d):
    return rounded(R.results_summary(_log(spark, d)), *_NAMES)


@register("best_results", f", {_EXPANDED.strip()}, {_SUMMARY.strip()}" + """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY data_name, model_name
                               ORDER BY precision_at_5 DESC NULLS LAST, seq) AS rn FROM summary)
WHERE rn = 1""")
def q_best(spark, d):
    return rounded(R.best_results(_log(spark, d), "precision_at_5"), *_NAMES)


@register("latest_results", f", {_EXPANDED.strip()}" + """
SELECT data_name, model_name, execute_date, param AS param_summary, seq, ndcg_at_5, precision_at_5 FROM (
  SELECT *, row_number() OVER (PARTITION BY data_name, model_name
                               ORDER BY TRY_CAST(execute_date AS BIGINT) DESC NULLS LAST, execute_date DESC, seq) AS rn
  FROM expanded)
WHERE rn = 1""")
def q_latest(spark, d):
    return rounded(R.latest_results(_log(spark, d)), *_NAMES)


@register("upsert_results", """
SELECT min(seq) AS seq, data_name, model_name, execute_date, param, arg_max(metrics, seq) AS metrics
FROM results_fx GROUP BY data_name, model_name, execute_date, param""", ("results_fx",))
def q_upsert(spark, d):
    return R.upsert_results(_log(spark, d))


@register("migrate_wide_results", f", {_EXPANDED.strip()}" + """,
w AS (SELECT *, min(seq) OVER (PARTITION BY data_name, model_name, execute_date, param) AS first_seq,
             row_number() OVER (PARTITION BY data_name, model_name, execute_date, param ORDER BY seq DESC) AS rn
      FROM expanded)
SELECT first_seq AS seq, data_name, model_name, execute_date, param,
       CAST(CAST(ndcg_at_5 IS NOT NULL AS INTEGER) + CAST(precision_at_5 IS NOT NULL AS INTEGER) AS INTEGER) AS n_metrics,
       ndcg_at_5, precision_at_5
FROM w WHERE rn = 1""")
def q_migrate(spark, d):
    wide = R.expand_metrics(_log(spark, d), list(_NAMES)).drop("metrics")
    mig = R.migrate_wide(wide, order_col="seq")
    m = R.parse_metrics("metrics")
    out = mig.select("seq", *R.KEY, "param", F.size(m).cast("int").alias("n_metrics"),
                     *[m.getItem(n).alias(n) for n in _NAMES])
    return rounded(out, *_NAMES)


for _n in ("expand_metrics", "results_summary", "best_results", "latest_results", "migrate_wide_results"):
    ORACLE[_n] = _prefix() + ORACLE[_n]
