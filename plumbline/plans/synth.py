"""Synthetic-plan and QA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import color, text
from plumbline.functions import taxonomy as tax
from plumbline.operators import qa as Q
from plumbline.operators import synth as S
from plumbline.plans.adapters import INDEX, index, table
from plumbline.plans.named import query

BASE = 7
_DIM = "dim(label, sub_type, ord, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {k}, {w}::DOUBLE)" for a, subs in S.SUBTYPES.items() for k, (b, w) in enumerate(subs.items())) + ")"
_COUNTS = "cnt AS (SELECT label, 20 + (SELECT count(*) FROM documents WHERE doc_id % 13 = label_id) AS n FROM tax WHERE label <> 'photo')"
_ALLOC = f"WITH {tax.SQL}, {_DIM}, {_COUNTS}" + """,
ex AS (SELECT dim.*, n AS total, n * weight / sum(weight) OVER (PARTITION BY label) AS exact FROM cnt JOIN dim USING (label)),
lo AS (SELECT *, CAST(floor(exact) AS BIGINT) AS low FROM ex),
rk AS (SELECT *, total - sum(low) OVER (PARTITION BY label) AS lft, row_number() OVER (PARTITION BY label ORDER BY round(exact - low, 9) DESC, ord) AS rank FROM lo),
al AS (SELECT label, sub_type, ord, CAST(low + (rank <= lft)::INT AS BIGINT) AS n FROM rk)
"""
_PLAN = _ALLOC + """,
st AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM al),
pl AS (SELECT label, sub_type, CAST(unnest(range(CAST(b AS BIGINT), CAST(b + n AS BIGINT))) AS BIGINT) AS i FROM st WHERE n > 0),
sd AS (SELECT *, CAST('0x' || substr(sha1('7|' || label || '|' || sub_type || '|' || i), 1, 8) AS BIGINT) AS seed FROM pl)
"""


def _counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % tax.K).cast("int").alias("label_id")).count()
    return tax.dimension(spark).filter("label <> 'photo'").join(F.broadcast(d), "label_id", "left").select("label", (20 + F.coalesce("count", F.lit(0))).alias("n"))


def _tasks(spark, sf_dir):
    return S.task_plan(_counts(spark, sf_dir), S.subtype_dimension(spark), BASE)


@query("synth_seed_sha1", "SELECT l_orderkey, l_linenumber, l_partkey, CAST('0x' || substr(sha1('7|' || l_returnflag || '|' || l_linestatus || '|' || l_partkey), 1, 8) AS BIGINT) AS seed FROM lineitem")
def seed_sha1(spark, sf_dir):
    seed = S.seed_for(F.lit(BASE), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seed.alias("seed"))


@query("synth_allocate", _ALLOC + "SELECT * FROM al")
def allocate(spark, sf_dir):
    return S.allocate(_counts(spark, sf_dir), S.subtype_dimension(spark))


@query("synth_task_plan", _PLAN + "SELECT * FROM sd")
def task_plan(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query("synth_regenerate_parse", _PLAN + "SELECT label || '__' || sub_type || '__' || seed AS crop_id, label, sub_type, seed FROM sd")
def regenerate_parse(spark, sf_dir):
    t = _tasks(spark, sf_dir).select(S.crop_id(F.col("label"), F.col("sub_type"), F.col("seed")).alias("crop_id"))
    label, sub, seed = S.parse_crop_id(F.col("crop_id"))
    return t.select("crop_id", label.alias("label"), sub.alias("sub_type"), seed.alias("seed"))


#: Structure counters of an order, by arithmetic on its lines.
_STRUCT = {
    "bar_series": "n % 3", "bars_total": "q % 7", "segments_per_bar": "1 + q % 4 // 3", "bars_on_baseline": "q % 7 - (o_orderkey % 5) // 4", "bars_floating": "n % 4",
    "line_series": "o_orderkey % 2", "pie_segments": "n % 5", "scatter_points": "q % 11", "flow_nodes": "n % 4", "table_rows": "n % 5", "table_cols": "q % 5",
}
_FLAGS = {"connectors": "o_orderkey % 7 = 0", "line_is_reference": "q % 3 = 0", "line_own_axis": "q % 4 = 1", "line_in_legend": "n % 4 = 1", "table_has_graphics": "q % 6 = 5"}
_ORDERS = "o AS (SELECT o_orderkey, coalesce(n, 0) AS n, CAST(coalesce(q, 0) AS BIGINT) AS q FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_STRUCTS = f"WITH {tax.SQL}, {_ORDERS}, s AS (SELECT o_orderkey, label, " + ", ".join(f"{v} AS {k}" for k, v in (_STRUCT | _FLAGS).items()) + ", (q % 100) / 100.0::DOUBLE AS geometry_area_frac FROM o JOIN tax ON label_id = o_orderkey % 13)"
_VIOLATION = """CASE label
WHEN 'bar' THEN CASE WHEN bars_total < 3 THEN 'bars_total is not >= 3' WHEN bar_series <> 1 THEN 'bar_series is not = 1' WHEN segments_per_bar <> 1 THEN 'segments_per_bar is not = 1' WHEN bars_on_baseline <> bars_total THEN 'bars_off_baseline is not = 0' WHEN line_series > 0 AND NOT line_is_reference THEN 'data_lines is not = 0' WHEN connectors THEN 'connectors is not = 0' END
WHEN 'bar_grouped' THEN CASE WHEN bar_series < 2 THEN 'bar_series is not >= 2' WHEN segments_per_bar <> 1 THEN 'segments_per_bar is not = 1' WHEN bars_on_baseline <> bars_total THEN 'bars_off_baseline is not = 0' WHEN line_series > 0 AND NOT line_is_reference THEN 'data_lines is not = 0' WHEN connectors THEN 'connectors is not = 0' END
WHEN 'bar_stacked' THEN CASE WHEN bars_total < 2 THEN 'bars_total is not >= 2' WHEN segments_per_bar < 2 THEN 'segments_per_bar is not >= 2' WHEN bars_on_baseline <> bars_total THEN 'bars_off_baseline is not = 0' WHEN connectors THEN 'connectors is not = 0' END
WHEN 'waterfall' THEN CASE WHEN bars_total < 4 THEN 'bars_total is not >= 4' WHEN bars_floating < 2 THEN 'bars_floating is not >= 2' WHEN bars_on_baseline < 2 THEN 'bars_on_baseline is not >= 2' WHEN segments_per_bar <> 1 THEN 'segments_per_bar is not = 1' END
WHEN 'line' THEN CASE WHEN line_series < 1 THEN 'line_series is not >= 1' WHEN bar_series <> 0 THEN 'bar_series is not = 0' END
WHEN 'combo_bar_line' THEN CASE WHEN bar_series < 1 THEN 'bar_series is not >= 1' WHEN line_series < 1 THEN 'line_series is not >= 1' WHEN line_is_reference THEN 'line_is_reference is not = 0' WHEN NOT (line_own_axis OR line_in_legend) THEN 'line_marks is not >= 1' END
WHEN 'pie_donut' THEN CASE WHEN pie_segments < 2 THEN 'pie_segments is not >= 2' END
WHEN 'scatter' THEN CASE WHEN scatter_points < 5 THEN 'scatter_points is not >= 5' WHEN bar_series <> 0 OR pie_segments <> 0 THEN 'bars_and_segments is not = 0' WHEN line_series > 0 AND NOT line_is_reference THEN 'data_lines is not = 0' END
WHEN 'flow' THEN CASE WHEN flow_nodes < 2 THEN 'flow_nodes is not >= 2' END
WHEN 'map' THEN CASE WHEN geometry_area_frac < 0.45 THEN 'geometry_area_frac is not >= 0.45' END
WHEN 'table' THEN CASE WHEN table_rows < 2 OR table_cols < 2 THEN 'grid_side is not >= 2' WHEN table_has_graphics THEN 'table_has_graphics is not = 0' END END"""


def _structs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("q"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n", "q"])
    made = {k: F.expr(v.replace("//", "div")) for k, v in (_STRUCT | _FLAGS).items()}
    return o.select("o_orderkey", tax.label_at(F.col("o_orderkey") % tax.K).alias("label"), *[v.alias(k) for k, v in made.items()], (F.col("q") % 100 / 100).alias("geometry_area_frac"))


@query("synth_invariant_violations", _STRUCTS + f" SELECT o_orderkey, label, {_VIOLATION} AS violation FROM s")
def invariant_violations(spark, sf_dir):
    return _structs(spark, sf_dir).select("o_orderkey", "label", S.violation(F.col("label")).alias("violation"))


@query("synth_retry_until_valid", _STRUCTS + f", v AS (SELECT o_orderkey // 5 AS task, o_orderkey % 5 AS attempt, {_VIOLATION} AS violation FROM s) SELECT task, min(attempt) FILTER (violation IS NULL) AS attempt, count(violation) AS rejected FROM v GROUP BY task")
def retry_until_valid(spark, sf_dir):
    v = _structs(spark, sf_dir).select(F.floor(F.col("o_orderkey") / S.MAX_RETRIES).alias("task"), (F.col("o_orderkey") % S.MAX_RETRIES).alias("attempt"), S.violation(F.col("label")).alias("violation"))
    return S.first_valid(v)


# Bars of a chart: the lines of an order, in an order that repeats no tie.
_ORDER = ["l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]
_BARS = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, CASE WHEN l_linenumber = 1 THEN 'start' WHEN l_linenumber % 4 = 0 THEN 'subtotal' ELSE 'delta' END AS kind, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN -l_quantity ELSE l_quantity END AS value FROM lineitem)"
_BY = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey"


def _bars(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "start").when(n % 4 == 0, "subtotal").otherwise("delta")
    value = F.when((F.col("l_returnflag") == "R") & (n > 1), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, "l_returnflag", kind.alias("kind"), value.alias("value"))


@query("synth_waterfall_levels", f"WITH {_BARS}, l AS (SELECT *, sum(CASE WHEN kind = 'subtotal' THEN 0 ELSE value END) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM b) SELECT l_orderkey, l_linenumber, l_partkey, kind, round(level, 4) + 0.0 AS level, round(CASE WHEN kind = 'delta' THEN least(level, level - value) ELSE 0 END, 4) + 0.0 AS bottom, round(CASE WHEN kind = 'delta' THEN abs(value) WHEN kind = 'start' THEN value ELSE level END, 4) + 0.0 AS height FROM l")
def waterfall_levels(spark, sf_dir):
    w = S.waterfall(_bars(spark, sf_dir), "l_orderkey", _ORDER)
    return w.select("l_orderkey", "l_linenumber", "l_partkey", "kind", *[(F.round(c, 4) + 0.0).alias(c) for c in ("level", "bottom", "height")])


@query("synth_stack_base", f"WITH {_BARS} SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(sum(abs(value)) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS base FROM b")
def stack_base(spark, sf_dir):
    b = _bars(spark, sf_dir).withColumn("value", F.abs("value"))
    return S.stack_base(b, ["l_orderkey"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", F.round("base", 4).alias("base"))


@query("synth_share_100", f"WITH {_BARS} SELECT l_orderkey, l_linenumber, l_partkey, round(100 * abs(value) / nullif(sum(abs(value)) OVER (PARTITION BY l_orderkey), 0), 4) AS share FROM b")
def share_100(spark, sf_dir):
    b = _bars(spark, sf_dir).withColumn("value", F.abs("value"))
    return S.share_100(b, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("share", 4).alias("share"))


@query("synth_change_column", f"WITH {_BARS}, c AS (SELECT l_orderkey, first(value ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS f, last(value ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS l FROM b GROUP BY 1) SELECT l_orderkey, round(l - f, 4) AS change, round(100 * (l - f) / nullif(abs(f), 0), 4) AS change_pct FROM c")
def change_column(spark, sf_dir):
    c = S.change_column(_bars(spark, sf_dir), "l_orderkey", _ORDER)
    return c.select("l_orderkey", F.round("change", 4).alias("change"), F.round("change_pct", 4).alias("change_pct"))


@query("synth_random_walk", f"WITH {_BARS} SELECT l_orderkey, l_linenumber, l_partkey, round(exp(sum(ln(1 + value / 997)) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS walk FROM b")
def random_walk(spark, sf_dir):
    b = _bars(spark, sf_dir).withColumn("rate", F.col("value") / 997)
    return S.random_walk(b, "l_orderkey", _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", F.round("walk", 6).alias("walk"))


@query("synth_number_format_de_en", "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS en, replace(replace(replace(format('{:,.2f}', p_retailprice), ',', '_'), '.', ','), '_', '.') AS de, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '' END || replace(replace(replace(format('{:,.1f}', CASE WHEN p_size % 2 = 0 THEN p_size * 100.5 ELSE -p_size * 100.5 END), ',', '_'), '.', ','), '_', '.') AS signed FROM part")
def number_format(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 100.5).otherwise(-F.col("p_size") * 100.5)
    return p.select("p_partkey", text.format_number(F.col("p_retailprice"), 2, "en").alias("en"), text.format_number(F.col("p_retailprice"), 2, "de").alias("de"), text.signed(v, 1, "de").alias("signed"))


@query("synth_number_parse", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0::DOUBLE ELSE round(p_retailprice, 2) END AS value FROM part")
def number_parse(spark, sf_dir):
    t = F.when(F.col("p_size") % 10 == 0, F.lit("n/a")).otherwise(text.format_number(F.col("p_retailprice"), 2, "de"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_number(t, "de").alias("value"))


@query("synth_decimals", "SELECT p_partkey, CAST(CASE WHEN abs(p_retailprice - 900) >= 1000 THEN 0 WHEN abs(p_retailprice - 900) >= 100 THEN least(p_size % 3, 1) ELSE p_size % 3 END AS INTEGER) AS decimals FROM part")
def decimals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.decimals_for(F.col("p_retailprice") - 900, F.col("p_size") % 3).alias("decimals"))


@query("synth_period_labels", """SELECT p_partkey, list_transform(range(2015 + p_size % 10 - 4, 2015 + p_size % 10 + 1), lambda y: CAST(y AS VARCHAR)) AS years, list_transform(range(2015 + p_size % 10 - 4, 2015 + p_size % 10 + 1), lambda y: '''' || lpad(CAST(y % 100 AS VARCHAR), 2, '0')) AS short_years,
  list_transform(range(0, 6), lambda i: 'Q' || ((p_size % 4 + i) % 4 + 1) || '/' || lpad(CAST((2021 + (p_size % 4 + i) // 4) % 100 AS VARCHAR), 2, '0')) AS quarters FROM part""")
def period_labels(spark, sf_dir):
    end = 2015 + F.col("p_size") % 10
    return table(spark, sf_dir, "part").select("p_partkey", text.year_labels(end, 5).alias("years"), text.year_labels(end, 5, True).alias("short_years"), text.quarter_labels(F.col("p_size") % 4 + 1, F.lit(2021), 6, True).alias("quarters"))


@query("synth_tick_picks", "SELECT p_partkey, CASE WHEN p_size <= 7 THEN list_transform(range(0, p_size), lambda i: CAST(i AS INTEGER)) ELSE list_transform(range(0, 7), lambda i: CAST(round_even(i * (p_size - 1) / 6.0::DOUBLE, 0) AS INTEGER)) END AS ticks FROM part")
def tick_picks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.tick_picks(F.col("p_size"), F.lit(7)).alias("ticks"))


@query("synth_polygon_area", """WITH p AS (SELECT c_custkey, list_transform(range(0, 12), lambda i: {'x': (100 + (c_custkey * 7 + i * i * 13) % 50) * cos(2 * pi() * i / 12), 'y': (100 + (c_custkey * 7 + i * i * 13) % 50) * sin(2 * pi() * i / 12)}) AS p FROM customer)
SELECT c_custkey, round(abs(list_sum(list_transform(range(1, 13), lambda i: p[i].x * p[i % 12 + 1].y - p[i % 12 + 1].x * p[i].y))) / 2, 4) AS area FROM p""")
def polygon_area(spark, sf_dir):
    def point(i):
        r = 100 + (F.col("c_custkey") * 7 + i * i * 13) % 50
        a = 2 * F.pi() * i / 12
        return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))

    c = table(spark, sf_dir, "customer").select("c_custkey", F.transform(F.sequence(F.lit(0), F.lit(11)), point).alias("p"))
    return c.select("c_custkey", F.round(color.polygon_area(F.col("p")), 4).alias("area"))


_HEX = "printf('#%02x%02x%02x', (c_custkey * 37) % 256, (c_custkey * 91) % 256, (c_custkey * 53) % 256)"


def _lum(r, g, b):
    return f"((0.2126::DOUBLE * {r} + 0.7152::DOUBLE * {g} + 0.0722::DOUBLE * {b}) / 255.0::DOUBLE)"


@query("synth_color_math", f"""WITH c AS (SELECT c_custkey, {_HEX} AS color, (c_custkey * 37) % 256 AS r, (c_custkey * 91) % 256 AS g, (c_custkey * 53) % 256 AS b FROM customer)
SELECT c_custkey, color, round({_lum('r', 'g', 'b')}, 6) AS luminance, CASE WHEN {_lum('r', 'g', 'b')} < 0.45 THEN '#f2f4f7' ELSE '#1b1f24' END AS readable,
  printf('#%02x%02x%02x', CAST(round_even(r + (255 - r) * 0.25::DOUBLE, 0) AS BIGINT), CAST(round_even(g + (255 - g) * 0.25::DOUBLE, 0) AS BIGINT), CAST(round_even(b + (255 - b) * 0.25::DOUBLE, 0) AS BIGINT)) AS lighter FROM c""")
def color_math(spark, sf_dir):
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("#%02x%02x%02x", (i * 37) % 256, (i * 91) % 256, (i * 53) % 256).alias("color"))
    return c.select("c_custkey", "color", F.round(color.luminance(F.col("color")), 6).alias("luminance"), color.readable_on(F.col("color")).alias("readable"), color.lighten(F.col("color"), 0.25).alias("lighter"))


_FALLBACK = ", ".join(f"({a}, {b})" for a, b in Q.FALLBACK_SIZES)


@query("synth_size_filter_fallback", f"""WITH s AS (SELECT 60 + (p_partkey * 7919) % 1500 AS width, 40 + (p_partkey * 104729) % 900 AS height FROM part), g AS (SELECT * FROM s WHERE width >= 120 AND height >= 120 AND width * height >= 30000 AND greatest(width / height::DOUBLE, height / width::DOUBLE) <= 8)
SELECT CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM g WHERE (SELECT count(*) FROM g) >= 30 UNION ALL SELECT * FROM (VALUES {_FALLBACK}) t(width, height) WHERE (SELECT count(*) FROM g) < 30""")
def size_filter_fallback(spark, sf_dir):
    i = F.col("p_partkey")
    return Q.size_cloud(table(spark, sf_dir, "part").select((60 + (i * 7919) % 1500).alias("width"), (40 + (i * 104729) % 900).alias("height")))


@query("photo_ingest_plan", "WITH " + INDEX + ", p AS (SELECT path, doc_id AS i, regexp_replace(split_part(path, '__', 1), '\\.[^.]+$', '') AS report FROM idx WHERE label = 'photo'), e AS (SELECT DISTINCT split_part(path, '__', 1) AS report FROM idx WHERE split = 'test') SELECT path, report, CAST(a AS INTEGER) AS aug_index, (7 + i * 131 + a * 7919) % 4294967296 AS seed, CASE WHEN a = 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS severity_scale FROM p, range(3) t(a) WHERE report NOT IN (SELECT report FROM e)")
def photo_ingest_plan(spark, sf_dir):
    i = index(spark, sf_dir)
    photos = i.filter("label = 'photo'").select("path", F.col("doc_id").alias("i"), text.report_stem(F.col("path")).alias("report"))
    exclude = i.filter("split = 'test'").select(text.report_stem(F.col("path")).alias("report")).distinct()
    return S.photo_plan(photos, exclude, 3, BASE).select("path", "report", "aug_index", "seed", "severity_scale")


@query("photo_reports_left", "WITH " + INDEX + ", p AS (SELECT path, regexp_replace(split_part(path, '__', 1), '\\.[^.]+$', '') AS report FROM idx WHERE label = 'photo'), e AS (SELECT DISTINCT split_part(path, '__', 1) AS report FROM idx WHERE split = 'test'), l AS (SELECT report, report NOT IN (SELECT report FROM e) AS kept FROM p) SELECT count(*) AS n_files, count(DISTINCT report) AS n_reports, count(*) FILTER (kept) AS n_kept, count(DISTINCT report) FILTER (kept) AS n_reports_left, count(DISTINCT report) FILTER (kept) > 1 AS splittable FROM l")
def photo_reports_left(spark, sf_dir):
    i = index(spark, sf_dir)
    photos = i.filter("label = 'photo'").select("path", text.report_stem(F.col("path")).alias("report"))
    return S.reports_left(photos, i.filter("split = 'test'").select(text.report_stem(F.col("path")).alias("report")))


_STATS = "o AS (SELECT o_orderkey, o_orderpriority AS style_preset, lower(c_mktsegment) || '_' || (o_custkey % 9) AS palette, o_orderstatus AS spines, o_orderkey % 9 <> 0 AS yaxis, (o_orderkey % 100) / 100.0::DOUBLE AS severity, o_orderkey % 3 = 0 AS hard_clip, 1 + o_orderkey % 2 AS jpeg_passes, o_orderkey % 10 = 1 AS greyscale, o_orderkey % 11 = 1 AS perspective, o_orderkey % 8 <> 0 AS degraded, (o_orderkey % 20) // 18 AS retry FROM orders JOIN customer ON c_custkey = o_custkey)"


def _stats(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    degrade = F.struct((k % 3 == 0).alias("hard_clip"), (1 + k % 2).alias("jpeg_passes"), (k % 10 == 1).alias("greyscale"), (k % 11 == 1).alias("perspective"))
    return o.select(
        "o_orderkey", F.col("o_orderpriority").alias("style_preset"), F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("o_custkey") % 9).cast("string")).alias("palette"), F.col("o_orderstatus").alias("spines"),
        (k % 9 != 0).alias("yaxis"), (k % 100 / 100).alias("severity"), F.when(k % 8 != 0, degrade).alias("degrade"), F.floor((k % 20) / 18).alias("retry"),
    )


@query("qa_value_counts", f"WITH {_STATS}, l AS (SELECT 'style_preset' AS field, style_preset AS value FROM o UNION ALL SELECT 'palette_family', split_part(palette, '_', 1) FROM o UNION ALL SELECT 'spines', spines FROM o UNION ALL SELECT 'yaxis', CAST(yaxis AS VARCHAR) FROM o) SELECT field, value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY field)::DOUBLE, 4) AS share FROM l GROUP BY field, value")
def value_counts(spark, sf_dir):
    s = _stats(spark, sf_dir).withColumn("palette_family", Q.palette_family("palette"))
    return Q.value_counts(s, ["style_preset", "palette_family", "spines", "yaxis"])


_Q5 = ", ".join(f"list_sort(list(v))[CAST(floor({p} * (count(*) - 1)) AS BIGINT) + 1] AS p{round(p * 100):02d}" for p in Q.QUANTILES)


@query("qa_quantiles_synth_vs_real", f"WITH s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'synth' ELSE 'real' END AS which, n_chars AS v FROM documents) SELECT which, {_Q5}, count(*) AS n FROM s GROUP BY which")
def quantiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, "synth").otherwise("real").alias("which"), F.col("n_chars").alias("v"))
    return Q.floor_quantiles(d, "which", "v")


@query("qa_coverage_rates", f"WITH {_STATS} SELECT count(*) AS n, round(100 * count(*) FILTER (spines = 'none') / count(*)::DOUBLE, 4) AS no_spines, round(100 * count(*) FILTER (NOT yaxis) / count(*)::DOUBLE, 4) AS no_yaxis, round(100 * count(*) FILTER (severity < 0.10) / count(*)::DOUBLE, 4) AS near_clean, " + ", ".join(f"round(100 * count(*) FILTER (degraded AND {c}) / count(*) FILTER (degraded)::DOUBLE, 4) AS {n}" for n, c in (("clipped", "hard_clip"), ("double_jpeg", "jpeg_passes >= 2"), ("greyscale", "greyscale"), ("perspective", "perspective"))) + " FROM o")
def coverage_rates(spark, sf_dir):
    return Q.coverage(_stats(spark, sf_dir))


@query("qa_retry_rate", f"WITH {_STATS} SELECT count(*) FILTER (retry > 0) AS retried, round(100 * avg((retry > 0)::INT), 4) AS rate FROM o")
def retry_rate(spark, sf_dir):
    return Q.retry_rate(_stats(spark, sf_dir))


@query("qa_contact_first64", "WITH " + INDEX + " SELECT label, path, CAST(row_number() OVER (PARTITION BY label ORDER BY source, path) AS INTEGER) AS rank FROM idx QUALIFY rank <= 64")
def contact_first64(spark, sf_dir):
    return Q.first_by_group(index(spark, sf_dir), "label", ["source", "path"]).select("label", "path", "rank")
