"""Judge-evaluation queries over the ``runs`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax
from plumbline.operators import judge as J
from plumbline.plans.adapters import RUNS, runs, table
from plumbline.plans.named import query

W = "WITH " + RUNS

# Reduced forms shared by the SQL below.
VOTES = """,
v AS (SELECT file, coalesce(pred, '__none__') AS pred, count(*) AS n, min(call_idx) AS first_idx FROM runs GROUP BY ALL),
vt AS (SELECT *, sum(n) OVER (PARTITION BY file) AS t FROM v),
pf AS (
  SELECT c.file, c."true", n_calls, votes, modal_pred, agreement, distinct_labels, entropy_bits, accuracy, mean_conf, conf_std
  FROM (SELECT file, arg_min("true", call_idx) AS "true", count(*) AS n_calls, avg(ok::INT) AS accuracy, avg(confidence) AS mean_conf, stddev_pop(confidence) AS conf_std FROM runs GROUP BY file) c
  JOIN (SELECT file, string_agg(pred || 'x' || n, ', ' ORDER BY n DESC, first_idx, pred) AS votes, first(pred ORDER BY n DESC, first_idx, pred) AS modal_pred,
      max(n) / max(t)::DOUBLE AS agreement, count(*) AS distinct_labels, abs(sum(-(n / t::DOUBLE) * log2(n / t::DOUBLE))) AS entropy_bits FROM vt GROUP BY file) USING (file))
"""
PRF = """,
prf AS (
  SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(images, 0) AS images, mean_conf
  FROM tax LEFT JOIN (SELECT "true" AS label, count(*) AS support, count(*) FILTER (pred = "true") AS tp, count(DISTINCT file) AS images, avg(confidence) AS mean_conf FROM runs GROUP BY 1) USING (label)
  LEFT JOIN (SELECT pred AS label, count(*) AS predicted FROM runs WHERE pred IS NOT NULL GROUP BY 1) USING (label)),
sc AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM prf)
"""
REL = """,
bins AS (SELECT greatest(CAST(ceil(confidence * 10) AS INTEGER) - 1, 0) AS bin, count(*) AS n, avg(confidence) AS mean_conf, avg(ok::INT) AS accuracy FROM runs WHERE pred IS NOT NULL AND confidence IS NOT NULL GROUP BY 1),
rel AS (SELECT CAST(r AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_conf, accuracy, abs(accuracy - mean_conf) AS gap FROM range(10) t(r) LEFT JOIN bins ON bin = r)
"""


@query("judge_tidy_runs", W + """SELECT file, "true", pred, confidence, CAST(call_idx AS BIGINT) AS call_idx, round(cost, 9) AS cost, error, ok FROM runs""")
def tidy_runs(spark, sf_dir):
    return J.tidy(runs(spark, sf_dir).drop("ok")).withColumn("cost", F.round("cost", 9))


@query("judge_overall", W + """SELECT count(*) AS n_calls, count(DISTINCT file) AS n_images, round(count(*) / count(DISTINCT file)::DOUBLE, 2) AS calls_per_image,
  count(DISTINCT "true") AS n_classes, round(avg(ok::INT), 6) AS micro_accuracy, (SELECT round(avg(a), 6) FROM (SELECT avg(ok::INT) AS a FROM runs GROUP BY "true")) AS macro_accuracy,
  count(*) FILTER (pred IS NULL) AS n_failed, round(count(*) FILTER (pred IS NULL) / count(*)::DOUBLE, 4) AS failed_rate, round(sum(cost), 4) AS cost_total, round(avg(cost), 6) AS cost_mean FROM runs""")
def overall(spark, sf_dir):
    return J.overall(runs(spark, sf_dir))


_BOOT = """,
files AS (SELECT file, row_number() OVER (ORDER BY substr(md5(file), 1, 3), file) - 1 AS idx FROM (SELECT DISTINCT file FROM runs)),
n AS (SELECT count(*) AS n FROM files),
d0 AS (SELECT rep, n, (rep * 1000003 + draw * 7919 + 12345) % 2147483647 AS h FROM range(2000) a(rep), n, range(n.n) b(draw)),
d1 AS (SELECT rep, n, (h * h + h * 48271 + 11) % 2147483647 AS h FROM d0),
d2 AS (SELECT rep, n, (h * h + h * 48271 + 11) % 2147483647 AS h FROM d1),
d AS (SELECT rep, (h * h + h * 48271 + 11) % 2147483647 % n AS idx FROM d2),
m AS (SELECT rep, idx, count(*) AS m FROM d GROUP BY ALL),
"""


@query("judge_bootstrap_micro", W + _BOOT + """s AS (SELECT file, count(*) AS n, sum(ok::INT) AS k FROM runs GROUP BY file),
a AS (SELECT rep, sum(m * k) / sum(m * s.n)::DOUBLE AS a FROM m JOIN files USING (idx) JOIN s USING (file) GROUP BY rep)
SELECT round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi, count(*) AS reps FROM a""")
def bootstrap_micro(spark, sf_dir):
    return J.bootstrap(runs(spark, sf_dir))


@query("judge_bootstrap_macro", W + _BOOT + """s AS (SELECT file, "true", count(*) AS n, sum(ok::INT) AS k FROM runs GROUP BY file, "true"),
c AS (SELECT rep, "true", sum(m * k) / sum(m * s.n)::DOUBLE AS a FROM m JOIN files USING (idx) JOIN s USING (file) GROUP BY rep, "true"),
a AS (SELECT rep, avg(a) AS a FROM c GROUP BY rep)
SELECT round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi, count(*) AS reps FROM a""")
def bootstrap_macro(spark, sf_dir):
    return J.bootstrap(runs(spark, sf_dir), macro=True)


@query("judge_confusion_counts", W + """SELECT "true", pred, count(*) AS n FROM runs WHERE pred IS NOT NULL GROUP BY ALL""")
def confusion_counts(spark, sf_dir):
    return J.confusion_counts(runs(spark, sf_dir))


@query("judge_confusion_normalized", W + """SELECT "true", pred, n, round(n / sum(n) OVER (PARTITION BY "true")::DOUBLE, 6) AS share FROM (SELECT "true", pred, count(*) AS n FROM runs WHERE pred IS NOT NULL GROUP BY ALL)""")
def confusion_normalized(spark, sf_dir):
    return J.confusion_normalized(runs(spark, sf_dir))


@query("judge_confusion_pivot", W + 'SELECT label AS "true", ' + ", ".join(f"count(*) FILTER (pred = '{x}') AS {x if x != 'table' else chr(34) + 'table' + chr(34)}" for x in tax.LABELS) + ' FROM tax LEFT JOIN runs ON label = "true" GROUP BY label')
def confusion_pivot(spark, sf_dir):
    return J.confusion_pivot(runs(spark, sf_dir))


@query("judge_per_class", W + PRF + 'SELECT label, images, support AS calls, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(mean_conf, 6) AS mean_conf FROM sc')
def per_class(spark, sf_dir):
    return J.per_class(runs(spark, sf_dir))


@query("judge_macro_weighted_f1", W + PRF + "SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM sc")
def macro_weighted_f1(spark, sf_dir):
    return J.macro_weighted_f1(runs(spark, sf_dir))


@query("judge_per_file", W + VOTES + """SELECT file, "true", n_calls, votes, modal_pred, round(agreement, 6) AS agreement, distinct_labels, round(entropy_bits, 6) AS entropy_bits, round(accuracy, 6) AS accuracy, round(mean_conf, 6) AS mean_conf, round(conf_std, 6) AS conf_std FROM pf""")
def per_file(spark, sf_dir):
    return J.per_file_table(runs(spark, sf_dir))


@query("judge_buckets", W + VOTES + "SELECT count(*) FILTER (accuracy = 0) AS n_always_wrong, count(*) FILTER (accuracy = 1) AS n_always_right, count(*) FILTER (distinct_labels > 1) AS n_flippy FROM pf")
def buckets(spark, sf_dir):
    return J.buckets(runs(spark, sf_dir))


@query("judge_consistency", W + VOTES + "SELECT round(avg(agreement), 6) AS agreement_mean, round(avg((distinct_labels > 1)::INT), 6) AS flip_rate, round(avg(entropy_bits), 6) AS mean_entropy_bits, round(avg(conf_std), 6) AS mean_conf_std FROM pf")
def consistency(spark, sf_dir):
    return J.consistency(runs(spark, sf_dir))


@query("judge_consistency_by_class", W + VOTES + 'SELECT "true", round(avg(agreement), 6) AS agreement, round(avg((distinct_labels > 1)::INT), 6) AS flip_rate, round(avg(entropy_bits), 6) AS mean_entropy FROM pf GROUP BY 1')
def consistency_by_class(spark, sf_dir):
    return J.consistency(runs(spark, sf_dir), by_class=True)


@query("judge_reliability_bins", W + REL + "SELECT bin, round(bin / 10.0::DOUBLE, 6) AS bin_lo, round((bin + 1) / 10.0::DOUBLE, 6) AS bin_hi, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM rel")
def reliability_bins(spark, sf_dir):
    return J.reliability_table(runs(spark, sf_dir))


@query("judge_ece_mce", W + REL + "SELECT round(sum(n * coalesce(gap, 0)) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM rel")
def ece_mce(spark, sf_dir):
    return J.ece_mce(runs(spark, sf_dir))


@query("judge_losses", W + """,
u AS (SELECT ok, confidence AS c, least(greatest(confidence, 1e-12), 1 - 1e-12) AS own, least(greatest((1 - confidence) / 12, 1e-12), 1 - 1e-12) AS rest FROM runs WHERE pred IS NOT NULL AND confidence IS NOT NULL),
f AS (SELECT file, arg_min("true", call_idx) AS t, count(pred) AS answered FROM runs GROUP BY file),
h AS (SELECT file, pred AS t, count(*) AS n FROM runs WHERE pred IS NOT NULL GROUP BY ALL)
SELECT round(avg(-ln(CASE WHEN ok THEN own ELSE rest END / (own + 12 * rest))), 6) AS confidence_logloss,
  (SELECT round(avg(-ln((coalesce(n, 0) + 0.5) / (answered + 6.5))), 6) FROM f LEFT JOIN h USING (file, t)) AS empirical_logloss,
  round(avg(pow(c - ok::INT, 2)), 6) AS brier_top_label,
  (SELECT round(avg(confidence), 6) FROM runs WHERE ok) AS mean_conf_correct, (SELECT round(avg(confidence), 6) FROM runs WHERE NOT ok) AS mean_conf_wrong FROM u""")
def losses(spark, sf_dir):
    return J.losses(runs(spark, sf_dir))


@query("judge_validate_warnings", W + """SELECT * FROM (
  SELECT 'true labels outside taxonomy' AS warning, 0 AS n UNION ALL
  SELECT 'failed calls', count(*) FROM runs WHERE pred IS NULL UNION ALL
  SELECT 'uneven repeat counts', CASE WHEN count(DISTINCT r) > 1 THEN count(DISTINCT r) ELSE 0 END FROM (SELECT count(DISTINCT call_idx) AS r FROM runs GROUP BY file)) WHERE n > 0""")
def validate_warnings(spark, sf_dir):
    return J.validate(runs(spark, sf_dir))


@query("judge_prf_long", W + PRF + 'SELECT label, metric, round("value", 6) AS "value" FROM (UNPIVOT (SELECT label, "precision", recall, f1 FROM sc) ON "precision", recall, f1 INTO NAME metric VALUE "value")')
def prf_long(spark, sf_dir):
    return J.prf_long(runs(spark, sf_dir))


@query("judge_conf_histogram", W + "SELECT least(CAST(floor(confidence * 20) AS INTEGER), 19) AS bin, ok, count(*) AS n FROM runs WHERE confidence IS NOT NULL GROUP BY ALL")
def conf_histogram(spark, sf_dir):
    return J.confidence_histogram(runs(spark, sf_dir))


@query("judge_agreement_histogram", W + VOTES + "SELECT least(CAST(floor(round(agreement * 10, 9)) AS INTEGER), 9) AS bin, count(*) AS n FROM pf GROUP BY 1")
def agreement_histogram(spark, sf_dir):
    return J.agreement_histogram(runs(spark, sf_dir))


@query("judge_failures", W + "SELECT file || '__c' || call_idx AS stem, file, CAST(call_idx AS BIGINT) AS call_idx, error FROM runs WHERE pred IS NULL")
def failures(spark, sf_dir):
    return J.failures(runs(spark, sf_dir))


@query("judge_call_plan", "SELECT doc_id AS image, CAST(r AS INTEGER) AS call_idx FROM documents, range(5) t(r)")
def call_plan(spark, sf_dir):
    return J.call_plan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image")), 5)


@query("judge_retry_fold", "SELECT event_id // 3 AS call, round(sum(value / 10000), 6) AS cost, arg_max(event_type, event_id % 3) AS pred, count(*) AS attempts FROM events GROUP BY 1")
def retry_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return J.retry_fold(e.select(F.floor(F.col("event_id") / 3).alias("call"), (F.col("event_id") % 3).alias("attempt"), (F.col("value") / 10000).alias("cost"), F.col("event_type").alias("pred")))


@query("judge_run_totals", W + "SELECT count(*) AS n_calls, count(*) FILTER (pred IS NULL) AS n_failed, round(sum(cost), 4) AS cost_total, count(*) // 25 AS progress_lines FROM runs")
def run_totals(spark, sf_dir):
    return J.run_totals(runs(spark, sf_dir))
