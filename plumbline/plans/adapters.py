"""The driver's tables in the shapes of the library's records, for Spark and (``SQL``) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge calls from events: a user is a file, an event a call, an ``error`` event a failed call."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    failed = F.col("event_type") == "error"
    right = F.col("event_type").isin("view", "click")
    true = F.col("user_id") % tax.K
    pred = F.when(failed, None).when(right, true).otherwise((F.col("user_id") + F.col("event_id")) % tax.K)
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("file"), tax.label_at(true).alias("true"), tax.label_at(pred).alias("pred"),
        F.when(~failed, (F.col("event_id") % 101) / 100).alias("confidence"), (F.row_number().over(order) - 1).cast("long").alias("call_idx"),
        (F.col("value") / 10000).alias("cost"), F.when(failed, F.lit("no message in LLM response")).alias("error"),
        F.coalesce(pred == true, F.lit(False)).alias("ok"),
    )


RUNS = f"""
{tax.SQL},
runs AS (
  SELECT CAST(user_id AS VARCHAR) AS file, t.label AS "true", p.label AS pred,
    CASE WHEN event_type <> 'error' THEN (event_id % 101) / 100.0::DOUBLE END AS confidence,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS call_idx,
    value / 10000 AS cost, CASE WHEN event_type = 'error' THEN 'no message in LLM response' END AS error,
    coalesce(p.label_id = t.label_id, false) AS ok
  FROM events e JOIN tax t ON t.label_id = e.user_id % 13
  LEFT JOIN tax p ON p.label_id = CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('view', 'click') THEN e.user_id % 13 ELSE (e.user_id + e.event_id) % 13 END)
"""


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, probs, target): a softmax over the first thirteen dimensions."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    z = F.transform(F.slice("embedding", 1, tax.K), lambda x: x.cast("double"))
    ez = e.select("vec_id", "label", z.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return ez.select(F.col("vec_id").alias("id"), F.transform("e", lambda x: x / total).alias("probs"), F.col("label").cast("int").alias("target"))


PROBS = f"""
{tax.SQL},
z AS (SELECT vec_id, label, list_transform(embedding[1:13], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
ez AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
probs AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS target, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ez),
pred AS (SELECT id, target, probs, list_position(probs, list_max(probs)) - 1 AS pred, list_max(probs) AS p_pred, probs[target + 1] AS p_true FROM probs)
"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted figures from documents; sizes, labels and confidences by integer arithmetic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.concat("source", F.lit("_ann_rep_2024_"), "lang", F.lit(".pdf")).alias("source_pdf"), "source",
        F.when(i % 17 != 0, i % 40).alias("page"), (60 + (i * 7919) % 1500).alias("width"), (40 + (i * 104729) % 900).alias("height"),
        (i % 50).alias("luma_min"), (i % 50 + (i * 31) % 206).alias("luma_max"), (i % 26).alias("raw_id"),
        ((i * 37) % 101 / 100).alias("raw_confidence"), F.when(i % 7 == 0, "table").otherwise("picture").alias("kind"),
        F.when(i % 3 == 0, tax.label_at(F.col("n_chars") % tax.K)).alias("llm_label"), F.when(i % 3 == 0, (i * 53) % 101 / 100).alias("llm_confidence"), F.when(i % 3 == 0, (i % 90) / 10000).alias("llm_cost"),
    )


CROPS = f"""
{tax.SQL},
crops AS (
  SELECT doc_id, source || '_ann_rep_2024_' || lang || '.pdf' AS source_pdf, source,
    CASE WHEN doc_id % 17 <> 0 THEN doc_id % 40 END AS page, 60 + (doc_id * 7919) % 1500 AS width, 40 + (doc_id * 104729) % 900 AS height,
    doc_id % 50 AS luma_min, doc_id % 50 + (doc_id * 31) % 206 AS luma_max, doc_id % 26 AS raw_id,
    ((doc_id * 37) % 101) / 100.0::DOUBLE AS raw_confidence, CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'picture' END AS kind,
    CASE WHEN doc_id % 3 = 0 THEN label END AS llm_label, CASE WHEN doc_id % 3 = 0 THEN ((doc_id * 53) % 101) / 100.0::DOUBLE END AS llm_confidence,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 90) / 10000.0::DOUBLE END AS llm_cost
  FROM documents LEFT JOIN tax ON label_id = n_chars % 13)
"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, label, doc, source, part): reviewed crops; one in five is synthetic, one document in six held out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    label = tax.label_at(F.least(F.col("doc_id") % 17, F.lit(tax.K - 1)))
    synth = F.col("doc_id") % 5 == 0
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return d.select(
        F.concat("source", F.lit("__p"), F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0"), F.lit("__"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        label.alias("label"), F.when(~synth, F.col("source")).alias("doc"), F.when(synth, "synth").otherwise("real").alias("source"),
        F.when(n % 6 == 5, "test").when(n % 6 == 4, "val").otherwise("train").alias("split"), "doc_id",
    )


INDEX = f"""
{tax.SQL},
idx AS (
  SELECT source || '__p' || lpad(CAST(doc_id % 40 AS VARCHAR), 3, '0') || '__' || doc_id || '.png' AS path, label,
    CASE WHEN doc_id % 5 <> 0 THEN source END AS doc, CASE WHEN doc_id % 5 = 0 THEN 'synth' ELSE 'real' END AS source,
    CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 6 WHEN 5 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS split, doc_id
  FROM documents JOIN tax ON label_id = least(doc_id % 17, 12))
"""
