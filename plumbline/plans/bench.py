"""Scored-split queries over the ``probs`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax
from plumbline.operators import bench as B
from plumbline.plans.adapters import PROBS, probs, table
from plumbline.plans.named import query

W = "WITH " + PROBS
GROUPS = [["bar", "bar_grouped", "bar_stacked"], ["line", "combo_bar_line"]]
CHECKPOINT = [x for x in tax.LABELS if x not in ("map", "line")]
_PRF = """,
side AS (SELECT target AS cls, 1 AS s, 0 AS p, (target = pred)::INT AS tp FROM pred UNION ALL SELECT pred, 0, 1, 0 FROM pred),
prf AS (SELECT label_id AS cls, CAST(coalesce(sum(s), 0) AS BIGINT) AS support, CAST(coalesce(sum(p), 0) AS BIGINT) AS predicted, coalesce(sum(tp), 0) AS tp FROM tax LEFT JOIN side ON cls = label_id GROUP BY label_id),
sc AS (SELECT cls, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0), 6) AS f1, support, predicted FROM prf)
"""


@query("bench_argmax", W + "SELECT id, target, CAST(pred AS INTEGER) AS pred, round(p_pred, 6) AS p_pred FROM pred")
def argmax(spark, sf_dir):
    return B.scored(probs(spark, sf_dir)).select("id", "target", "pred", F.round("p_pred", 6).alias("p_pred"))


@query("bench_nll_accuracy", W + "SELECT round(-avg(ln(greatest(p_true, 1e-12))), 6) AS nll, round(avg((pred = target)::INT), 6) AS accuracy, count(*) AS n FROM pred")
def nll_accuracy(spark, sf_dir):
    return B.nll_accuracy(probs(spark, sf_dir))


@query("bench_confusion", W + "SELECT target, CAST(pred AS INTEGER) AS pred, count(*) AS n, round(count(*) / greatest(sum(count(*)) OVER (PARTITION BY target), 1)::DOUBLE, 6) AS share FROM pred GROUP BY target, pred")
def confusion(spark, sf_dir):
    return B.normalized(B.matrix(probs(spark, sf_dir)))


@query("bench_prf_present", W + _PRF + "SELECT * FROM sc WHERE support > 0 OR predicted > 0")
def prf_present(spark, sf_dir):
    return B.active(B.matrix(probs(spark, sf_dir)))


@query("bench_macro_f1_present", W + _PRF + "SELECT round(avg(f1), 5) AS macro_f1, count(*) AS classes FROM sc WHERE support > 0")
def macro_f1_present(spark, sf_dir):
    return B.macro_f1_present(B.matrix(probs(spark, sf_dir)))


_MAP = ", ".join(f"({a}, {b})" for a, b in B.merge_map(GROUPS)[1].items())


@query("bench_merge_classes", W + f""", g(old, new) AS (VALUES {_MAP}),
mp AS (SELECT id, a.new AS target, b.new AS pred FROM pred JOIN g a ON a.old = target JOIN g b ON b.old = pred),
own AS (SELECT id, sum(probs[o.old + 1]) AS p FROM probs JOIN g t ON t.old = target JOIN g o ON o.new = t.new GROUP BY id),
side AS (SELECT target AS cls, 1 AS s, 0 AS p, (target = pred)::INT AS tp FROM mp UNION ALL SELECT pred, 0, 1, 0 FROM mp),
f AS (SELECT cls, round(coalesce(2 * sum(tp) / nullif(sum(s) + sum(p), 0)::DOUBLE, 0), 6) AS f1, sum(s) AS s FROM side GROUP BY cls)
SELECT (SELECT round(avg(f1), 5) FROM f WHERE s > 0) AS macro_f1, (SELECT count(*) FROM f WHERE s > 0) AS classes, (SELECT round(avg((target = pred)::INT), 6) FROM mp) AS accuracy, (SELECT round(-avg(ln(greatest(p, 1e-12))), 6) FROM own) AS nll""")
def merge_classes(spark, sf_dir):
    return B.merged(probs(spark, sf_dir), GROUPS)


@query("bench_confusion_pairs_topk", W + "SELECT id, round(p_pred, 6) AS p_pred FROM pred WHERE target = 3 AND pred = 7 ORDER BY round(p_pred, 6) DESC, id LIMIT 16")
def confusion_pairs(spark, sf_dir):
    return B.confusion_pairs(probs(spark, sf_dir), 3, 7)


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), tax.label_at(F.col("label")).alias("label"))


@query("bench_label_remap_missing", "WITH " + tax.SQL + " SELECT t.label, count(*) AS n FROM embeddings e JOIN tax t ON t.label_id = e.label WHERE t.label IN ('map', 'line') GROUP BY 1")
def label_remap_missing(spark, sf_dir):
    return B.missing_labels(_targets(spark, sf_dir), CHECKPOINT)


@query("bench_label_remap", "WITH " + tax.SQL + ", c(model_id, label) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(reversed(tax.LABELS))) + ") SELECT vec_id AS id, label, model_id FROM embeddings e JOIN tax t ON t.label_id = e.label JOIN c USING (label)".replace("SELECT vec_id AS id, label,", "SELECT vec_id AS id, c.label AS label,").replace("JOIN c USING (label)", "JOIN c ON c.label = t.label"))
def label_remap(spark, sf_dir):
    return B.remap(_targets(spark, sf_dir), list(reversed(tax.LABELS))).select("id", "label", "model_id")


@query("bench_weighted_loss", "SELECT event_id % 50 AS epoch, round(sum(value * (1 + user_id % 16)) / sum(1 + user_id % 16), 6) AS loss FROM events GROUP BY 1")
def weighted_loss(spark, sf_dir):
    return B.weighted_loss(table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("epoch"), F.col("value").alias("loss"), (1 + F.col("user_id") % 16).alias("n")))
