"""Queries of scalar families: draws, vocabularies, layout and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import draws, layout, text, vocab
from plumbline.operators import figures, manifest
from plumbline.plans.adapters import INDEX, index, table
from plumbline.plans.named import query

_P = "CAST(p_partkey AS VARCHAR)"


@query("synth_hash_draws", f"""WITH u AS (SELECT p_partkey, {draws.unit_sql(_P, 'a')} AS u, {draws.unit_sql(_P, 'b')} AS v FROM part)
SELECT p_partkey, round(u, 9) AS u, CAST(3 + floor(u * 5) AS INTEGER) AS k, u < 0.25 AS yes, {draws.weighted_sql('v', figures.SHAPES)} AS shape, round(2 * sqrt(-2 * ln(1.0::DOUBLE - u)) * cos(2 * pi() * v), 6) AS z FROM u""")
def hash_draws(spark, sf_dir):
    u, v = draws.unit(F.col("p_partkey"), "a"), draws.unit(F.col("p_partkey"), "b")
    p = table(spark, sf_dir, "part").select("p_partkey", u.alias("u"), v.alias("v"))
    return p.select("p_partkey", F.round("u", 9).alias("u"), draws.integer(F.col("u"), 3, 7).alias("k"), draws.chance(F.col("u"), 0.25).alias("yes"), draws.weighted(F.col("v"), figures.SHAPES).alias("shape"), F.round(draws.normal(F.col("u"), F.col("v"), 0.0, 2.0), 6).alias("z"))


def _list(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


@query("synth_vocab_picks", f"""WITH u AS (SELECT p_partkey, {draws.unit_sql(_P, 'topic')} AS u, p_partkey % 2 = 0 AS de FROM part),
k AS (SELECT p_partkey, i, w, CAST('0x' || substr(md5({_P} || '|region|' || i), 1, 8) AS BIGINT) AS h FROM part, (SELECT unnest(range(0, 7)) AS i, unnest({_list(vocab.REGIONS['en'])}) AS w))
SELECT p_partkey, CASE WHEN de THEN {_list(t[0] for t in vocab.TOPICS['de'])} ELSE {_list(t[0] for t in vocab.TOPICS['en'])} END[CAST(floor(u * 8) AS BIGINT) + 1] AS topic, (SELECT list(w ORDER BY h, w)[1:3] FROM k WHERE k.p_partkey = u.p_partkey) AS regions FROM u""")
def vocab_picks(spark, sf_dir):
    lang = F.when(F.col("p_partkey") % 2 == 0, "de").otherwise("en")
    return table(spark, sf_dir, "part").select("p_partkey", vocab.topic(F.col("p_partkey"), lang).alias("topic"), vocab.categories(F.col("p_partkey"), F.lit("en"), "region", 3).alias("regions"))


@query("synth_layout_fit", """WITH m AS (SELECT p_partkey, (p_size % 10) / 13.0::DOUBLE AS lo, (p_size % 7) / 11.0::DOUBLE AS hi FROM part)
SELECT p_partkey, round(CASE WHEN lo + hi > 0.78 THEN lo * 0.78 / (lo + hi) ELSE lo END, 6) AS lo, round(CASE WHEN lo + hi > 0.78 THEN hi * 0.78 / (lo + hi) ELSE hi END, 6) AS hi FROM m""")
def layout_fit(spark, sf_dir):
    fit = layout.fit_axis((F.col("p_size") % 10) / 13, (F.col("p_size") % 7) / 11, 0.22)
    return table(spark, sf_dir, "part").select("p_partkey", fit.alias("f")).select("p_partkey", F.round("f.lo", 6).alias("lo"), F.round("f.hi", 6).alias("hi"))


@query("synth_minmax", """WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round((x - list_min(v)) / (list_max(v) - list_min(v) + 1e-9), 6)) AS v FROM v""")
def minmax(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(layout.normalize(v), lambda x: F.round(x, 6)).alias("v"))


_NAMES = [f"c{i}" for i in range(1, 7)]
_V6 = "v AS (SELECT vec_id, unnest(range(1, 7)) AS i, CAST(unnest(embedding[1:6]) AS DOUBLE) AS v, CAST(unnest(embedding[7:12]) AS DOUBLE) AS w FROM embeddings)"


@query("synth_ranked_bars", f"WITH {_V6} SELECT vec_id, list('c' || i ORDER BY v DESC, i) AS ranked, list('c' || i ORDER BY v, i) AS rising, list('c' || i ORDER BY abs(v) + abs(w) DESC, i) AS tornado FROM v GROUP BY vec_id")
def ranked_bars(spark, sf_dir):
    part = lambda at: F.transform(F.slice("embedding", at, 6), lambda x: x.cast("double"))
    names = F.array(*map(F.lit, _NAMES))
    name = lambda pairs: F.transform(pairs, lambda x: x["name"])
    return table(spark, sf_dir, "embeddings").select("vec_id", name(layout.ranked(names, part(1))).alias("ranked"), name(layout.ranked(names, part(1), True)).alias("rising"), layout.by_span(names, part(1), part(7)).alias("tornado"))


@query("text_url_filename", "SELECT page_id, list_last(string_split(regexp_extract(url, '^[^?#]*'), '/')) AS name FROM pages")
def url_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_filename(F.col("url")).alias("name"))


@query("text_run_stamp", "SELECT event_id, strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S') AS started FROM events")
def run_stamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    folder = F.concat(F.lit("runs/eval_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_x"))
    return e.select("event_id", text.run_stamp(folder).alias("started"))


@query("text_caption", "SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 24 THEN left(p_name || ' ' || p_type || ' ' || p_brand, 22) || '…' ELSE p_name || ' ' || p_type || ' ' || p_brand END AS caption FROM part")
def caption(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.caption(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 24).alias("caption"))


#: Word by word: a line is closed where the next word does not fit.
_WRAP = """WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM benchmark),
f(item_id, ws, i, done, line) AS (
  SELECT item_id, ws, 1, CAST([] AS VARCHAR[]), '' FROM w
  UNION ALL
  SELECT item_id, ws, i + 1, CASE WHEN line = '' OR length(line) + 1 + length(ws[i]) <= 40 THEN done ELSE list_append(done, line) END,
    CASE WHEN line = '' THEN ws[i] WHEN length(line) + 1 + length(ws[i]) <= 40 THEN line || ' ' || ws[i] ELSE ws[i] END
  FROM f WHERE i <= len(ws))
SELECT item_id, CASE WHEN line = '' THEN done ELSE list_append(done, line) END AS lines FROM f WHERE i = len(ws) + 1"""


@query("text_wrap", _WRAP)
def wrap(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", layout.wrap(F.col("text"), 40).alias("lines"))


@query("label_api_images", "WITH " + INDEX + " SELECT label AS folder, path AS file, doc_id % 3 <> 0 AS in_manifest, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 97 END AS page, CASE WHEN doc_id % 3 <> 0 THEN 'icon' END AS raw_label, CAST(NULL AS VARCHAR) AS manual_root FROM idx")
def api_images(spark, sf_dir):
    i = index(spark, sf_dir)
    records = i.filter("doc_id % 3 <> 0").select(F.col("path").alias("filename"), (F.col("doc_id") % 97).alias("page"), F.lit("icon").alias("raw_label"))
    shown = manifest.image_meta(i.select(F.col("path").alias("filename"), F.col("label").alias("folder")), records)
    return shown.select("folder", "file", "meta.in_manifest", "meta.page", "meta.raw_label", "meta.manual_root")


@query("label_api_folders", "WITH " + INDEX + " SELECT label AS folder, count(*) AS images, count(*) FILTER (doc_id % 3 <> 0) AS with_record FROM idx GROUP BY 1")
def api_folders(spark, sf_dir):
    i = index(spark, sf_dir)
    images = i.select(F.col("path").alias("filename"), F.col("label").alias("folder"))
    joined = manifest.join_images(images, i.filter("doc_id % 3 <> 0").select(F.col("path").alias("filename"), F.col("doc_id").alias("page")))
    return joined.groupBy("folder").agg(F.count(F.lit(1)).alias("images"), F.count_if("in_manifest").alias("with_record"))
