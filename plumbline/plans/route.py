"""Extraction-routing queries over the ``crops`` and ``replies`` adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import route as R
from plumbline.plans.adapters import CROPS, crops, table
from plumbline.plans.named import query

_RAW = list(R.RAW_TO_CLASS)
W = "WITH " + CROPS + ",\nraw(raw_id, raw_label, cls) AS (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(R.RAW_TO_CLASS.items())) + "),\nc AS (SELECT crops.*, raw_label, cls FROM crops JOIN raw USING (raw_id))"
_REVIEW = "raw_confidence < 0.75 OR raw_label IN ('other', 'full_page_image', 'page_thumbnail', 'screenshot_from_computer')"
_JUNK = """CASE WHEN width < 120 OR height < 120 THEN printf('too_small_%dx%d', width, height) WHEN width * height < 30000 THEN printf('area_too_small_%d', width * height)
  WHEN greatest(width / height::DOUBLE, height / width::DOUBLE) > 8 THEN printf('extreme_aspect_%.1f', greatest(width / height::DOUBLE, height / width::DOUBLE)) WHEN luma_max - luma_min < 12 THEN 'near_uniform' END"""
_ROUTED = f"CASE WHEN kind = 'table' THEN 'table' WHEN llm_confidence > 0.75 THEN llm_label WHEN {_REVIEW} THEN '_review' ELSE cls END"


def _labelled(spark, sf_dir):
    c = crops(spark, sf_dir)
    return c.withColumn("raw_label", F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("raw_id") + 1).cast("int")))


@query("route_language", W + "SELECT doc_id, source_pdf, CASE WHEN lower(list_last(string_split(regexp_replace(source_pdf, '\\.[^.]+$', ''), '_'))) IN ('de', 'en') THEN lower(list_last(string_split(regexp_replace(source_pdf, '\\.[^.]+$', ''), '_'))) ELSE 'de' END AS language FROM c")
def language(spark, sf_dir):
    return crops(spark, sf_dir).select("doc_id", "source_pdf", text.language(F.col("source_pdf")).alias("language"))


@query("route_junk_reason", W + f"SELECT doc_id, {_JUNK} AS reason FROM c")
def junk_reason(spark, sf_dir):
    return crops(spark, sf_dir).select("doc_id", R.junk_reason(F.col("width"), F.col("height"), F.col("luma_min"), F.col("luma_max")).alias("reason"))


@query("route_map_label", W + f"SELECT doc_id, raw_label, cls AS proposed, CASE WHEN {_REVIEW} THEN '_review' ELSE cls END AS folder, CASE WHEN {_REVIEW} THEN 'manual' ELSE 'docling' END AS layer FROM c")
def map_label(spark, sf_dir):
    review = (F.col("raw_confidence") < R.THRESHOLD) | F.col("raw_label").isin(*R.ALWAYS_REVIEW)
    own = R.mapped(F.col("raw_label"))
    return _labelled(spark, sf_dir).select("doc_id", "raw_label", own.alias("proposed"), F.when(review, "_review").otherwise(own).alias("folder"), F.when(review, "manual").otherwise("docling").alias("layer"))


@query("route_decide", W + f"SELECT doc_id, kind, CASE WHEN kind = 'table' THEN 'table' ELSE cls END AS mapped_label, {_ROUTED} AS routed_to, CASE WHEN kind = 'table' THEN 'docling' WHEN llm_confidence > 0.75 THEN 'llm' WHEN {_REVIEW} THEN 'manual' ELSE 'docling' END AS decision_layer FROM c")
def decide(spark, sf_dir):
    return R.decide(_labelled(spark, sf_dir)).select("doc_id", "kind", "mapped_label", "routed_to", "decision_layer")


@query("route_ids", W + """, i AS (SELECT *, printf('%s__p%03d__%03d', regexp_replace(source_pdf, '\\.[^.]+$', ''), coalesce(page, 0), row_number() OVER (PARTITION BY source_pdf ORDER BY doc_id)) AS crop_id FROM c)
SELECT doc_id, crop_id, printf('%s__%s__%.2f.png', crop_id, cls, raw_confidence) AS filename FROM i""")
def ids(spark, sf_dir):
    return R.crop_ids(_labelled(spark, sf_dir), "doc_id").select("doc_id", "crop_id", "filename")


@query("route_totals", W + f", r AS (SELECT *, {_JUNK} AS reason, {_ROUTED} AS routed_to FROM c) SELECT count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason IS NOT NULL) AS n_junk, count(*) FILTER (reason IS NULL AND routed_to = '_review') AS n_review, round(sum(llm_cost) FILTER (reason IS NULL), 4) AS llm_cost FROM r")
def totals(spark, sf_dir):
    c = R.decide(_labelled(spark, sf_dir))
    return R.totals(c.withColumn("reason", R.junk_reason(F.col("width"), F.col("height"), F.col("luma_min"), F.col("luma_max"))))


@query("route_bbox_clip", W + """, b AS (SELECT doc_id, width::DOUBLE AS w, height::DOUBLE AS h, (doc_id % 37) * 20.0::DOUBLE - 40 AS x0, (doc_id % 41) * 10.0::DOUBLE - 30 AS x1, (doc_id % 23) * 30.0::DOUBLE AS y0, (doc_id % 19) * 35.0::DOUBLE - 20 AS y1 FROM c),
k AS (SELECT doc_id, greatest(least(x0, x1), 0) AS l, least(greatest(x0, x1), w) AS r, greatest(least(h - y0, h - y1), 0) AS t, least(greatest(h - y0, h - y1), h) AS b FROM b)
SELECT doc_id, l, t, r, b FROM k WHERE r > l AND b > t""")
def bbox_clip(spark, sf_dir):
    i = F.col("doc_id")
    box = R.bbox_clip((i % 37) * 20.0 - 40, (i % 23) * 30.0, (i % 41) * 10.0 - 30, (i % 19) * 35.0 - 20, F.col("width").cast("double"), F.col("height").cast("double"))
    return crops(spark, sf_dir).select("doc_id", box.alias("x")).filter("x IS NOT NULL").select("doc_id", "x.*")


@query("label_shares_rollup", W + ", s AS (SELECT coalesce(cls, 'x') AS label, count(*) AS n FROM c GROUP BY 1) SELECT label, n, round(100 * n / sum(n) OVER ()::DOUBLE, 4) AS share FROM s UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), 100.0 FROM s")
def label_shares(spark, sf_dir):
    return R.shares(_labelled(spark, sf_dir).select(R.mapped(F.col("raw_label")).alias("label")), "label")


# Replies: prose around the events' JSON, by turns.
_REPLY = """
ev AS (SELECT event_id, 'label_' || event_type AS l, (event_id % 130) / 100.0::DOUBLE AS c FROM events),
js AS (SELECT event_id, l, c, event_id % 8 AS k, printf('{"label": "%s", "confidence": %.2f}', l, c) AS j FROM ev),
replies AS (SELECT event_id, CASE k WHEN 0 THEN j WHEN 1 THEN '```json ' || j || ' ```' WHEN 2 THEN 'Here it is: ' || j || ' .' WHEN 3 THEN 'no answer' WHEN 4 THEN '' WHEN 5 THEN '{"label": "  ", "confidence": 0.5}' WHEN 6 THEN '{"label": "bar", "confidence": true}' ELSE '{"label": "bar", "confidence": "0.5"}' END AS content, l, c, k FROM js)
"""


def _replies(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("label_"), "event_type").alias("l"), ((F.col("event_id") % 130) / 100).alias("c"))
    j = F.format_string('{"label": "%s", "confidence": %.2f}', F.col("l"), F.col("c"))
    k = F.col("event_id") % 8
    content = (
        F.when(k == 0, j).when(k == 1, F.concat(F.lit("```json "), j, F.lit(" ```"))).when(k == 2, F.concat(F.lit("Here it is: "), j, F.lit(" ."))).when(k == 3, F.lit("no answer")).when(k == 4, F.lit(""))
        .when(k == 5, F.lit('{"label": "  ", "confidence": 0.5}')).when(k == 6, F.lit('{"label": "bar", "confidence": true}')).otherwise(F.lit('{"label": "bar", "confidence": "0.5"}'))
    )
    return e.select("event_id", content.alias("content"))


@query("llm_json_recovery", "WITH " + _REPLY + """SELECT event_id, CASE WHEN k < 3 THEN l WHEN k = 5 THEN '  ' WHEN k > 5 THEN 'bar' END AS label, k NOT IN (3, 4) AS recovered FROM replies""")
def json_recovery(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("v", text.json_object(F.col("content")))
    return r.select("event_id", F.try_variant_get("v", "$.label", "string").alias("label"), F.col("v").isNotNull().alias("recovered"))


@query("llm_validate_prediction", "WITH " + _REPLY + """SELECT event_id, CASE WHEN k < 3 AND c <= 1 THEN l END AS label, CASE WHEN k < 3 AND c <= 1 THEN c END AS confidence,
  CASE WHEN k = 4 THEN 'no message in LLM response' WHEN k = 3 THEN 'invalid JSON in LLM response' WHEN k < 3 AND c <= 1 THEN NULL ELSE 'response did not match the expected schema' END AS error FROM replies""")
def validate_prediction(spark, sf_dir):
    return R.validate_reply(_replies(spark, sf_dir)).select("event_id", "label", "confidence", "error")
