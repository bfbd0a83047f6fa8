"""Split, manifest and training-summary queries over the ``index`` adapter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import manifest as M
from plumbline.operators import split as S
from plumbline.plans.adapters import INDEX, index, table
from plumbline.plans.named import query

CAP = 40
W = "WITH " + INDEX
_CAP = f""",
dep AS (SELECT *, row_number() OVER (PARTITION BY label, doc ORDER BY sha1('0:' || label || ':' || path), path) AS depth FROM idx WHERE source = 'real' AND split = 'train'),
cap AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY depth, doc) AS rank FROM dep QUALIFY rank <= {CAP}),
written AS (SELECT path, label, split, source, doc FROM cap UNION ALL SELECT path, label, split, source, doc FROM idx WHERE source = 'real' AND split <> 'train' UNION ALL SELECT path, label, 'train', source, NULL FROM idx WHERE source = 'synth')
"""
_WIDE = _CAP + """,
wide AS (SELECT label, count(*) FILTER (source = 'real' AND split = 'train') AS train, count(*) FILTER (source = 'real' AND split = 'val') AS val, count(*) FILTER (source = 'real' AND split = 'test') AS test, count(*) FILTER (source = 'synth') AS synth FROM tax LEFT JOIN written USING (label) GROUP BY label)
"""


@query("split_doc_histogram", W + "SELECT doc, label, count(*) AS n FROM idx WHERE source = 'real' GROUP BY ALL")
def doc_histogram(spark, sf_dir):
    return S.doc_histogram(index(spark, sf_dir))


@query("split_cap_round_robin", W + _CAP + "SELECT label, doc, path, CAST(depth AS INTEGER) AS depth, CAST(rank AS INTEGER) AS rank FROM cap")
def cap_round_robin(spark, sf_dir):
    return S.cap_round_robin(index(spark, sf_dir), CAP).select("label", "doc", "path", "depth", "rank")


@query("split_index_union", W + _CAP + "SELECT * FROM written")
def index_union(spark, sf_dir):
    return S.index_rows(index(spark, sf_dir), CAP)


@query("split_leakage", W + "SELECT DISTINCT doc FROM idx WHERE source = 'real' AND split <> 'test' AND doc IN (SELECT source FROM documents WHERE doc_id % 31 = 0)")
def leakage(spark, sf_dir):
    i = index(spark, sf_dir).filter("source = 'real' AND split <> 'test'")
    held = table(spark, sf_dir, "documents").filter("doc_id % 31 = 0").select(F.col("source").alias("doc"))
    return S.leakage(i, held)


_GAP = "label NOT IN ('flow', 'map') OR split <> 'val'"


@query("split_gap_warnings", (W + _WIDE).replace("LEFT JOIN written USING (label)", f"LEFT JOIN (SELECT * FROM written WHERE ({_GAP}) AND label <> 'waterfall') written USING (label)") + "SELECT label, unnest(list_filter([CASE WHEN train + val + test = 0 THEN 'no real images' END, CASE WHEN train + val + test > 0 AND val = 0 THEN 'absent from val' END, CASE WHEN train + val + test > 0 AND test = 0 THEN 'absent from test' END, CASE WHEN synth = 0 THEN 'no synthetic images' END], lambda x: x IS NOT NULL)) AS warning FROM wide")
def gap_warnings(spark, sf_dir):
    return S.gap_warnings(S.index_rows(index(spark, sf_dir), CAP).filter(f"({_GAP}) AND label <> 'waterfall'"))


@query("split_counts_pivot", W + _WIDE + "SELECT *, train + synth AS train_synth FROM wide UNION ALL SELECT 'TOTAL', CAST(sum(train) AS BIGINT), CAST(sum(val) AS BIGINT), CAST(sum(test) AS BIGINT), CAST(sum(synth) AS BIGINT), CAST(sum(train + synth) AS BIGINT) FROM wide")
def counts_pivot(spark, sf_dir):
    return S.counts_pivot(S.index_rows(index(spark, sf_dir), CAP))


@query("split_docs_listed", W + "SELECT split, count(*) AS n_docs, string_agg(doc, ', ' ORDER BY doc) AS docs FROM (SELECT DISTINCT split, doc FROM idx WHERE source = 'real') GROUP BY split")
def docs_listed(spark, sf_dir):
    return S.docs_listed(index(spark, sf_dir))


@query("split_assign_greedy")
def assign_greedy(spark, sf_dir):
    return S.assigned_frame(index(spark, sf_dir))


@query("train_class_weights", W + ", n AS (SELECT label, greatest(count(path), 1) AS n FROM tax LEFT JOIN idx USING (label) GROUP BY label) SELECT label, n, round(sum(n) OVER () / (13 * n)::DOUBLE, 6) AS weight FROM n")
def class_weights(spark, sf_dir):
    return S.class_weights(index(spark, sf_dir))


@query("train_label_summary", W + "SELECT split, count(*) AS images, count(DISTINCT label) AS classes, 13 AS of FROM idx GROUP BY split")
def label_summary(spark, sf_dir):
    return S.label_summary(index(spark, sf_dir))


def _history(spark, sf_dir):
    """One training run a part size: epochs are the size's brands in turn."""
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey")
    n = (F.row_number().over(M.Window.partitionBy("p_size").orderBy("p_partkey"))).cast("long")
    return p.select(F.col("p_size").alias("run"), n.alias("epoch"), ((F.col("p_partkey") * 37) % 211 / 211).alias("val_macro_f1"), ((F.col("p_partkey") * 91) % 173 / 100).alias("val_loss")).filter("epoch <= 30")


_HISTORY = """
h AS (SELECT * FROM (SELECT p_size AS run, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS epoch, (p_partkey * 37) % 211 / 211.0::DOUBLE AS f1, (p_partkey * 91) % 173 / 100.0::DOUBLE AS loss FROM part) WHERE epoch <= 30),
f AS (
  SELECT run, epoch, epoch AS best, f1, loss, 0 AS idle FROM h WHERE epoch = 1
  UNION ALL
  SELECT h.run, h.epoch, CASE WHEN g THEN h.epoch ELSE f.best END, CASE WHEN g THEN h.f1 ELSE f.f1 END, CASE WHEN g THEN h.loss ELSE f.loss END, CASE WHEN g THEN 0 ELSE f.idle + 1 END
  FROM f JOIN (SELECT h.*, 1 FROM h) h ON h.run = f.run AND h.epoch = f.epoch + 1, LATERAL (SELECT h.f1 > f.f1 + 1e-6 OR (abs(h.f1 - f.f1) <= 1e-6 AND h.loss < f.loss) AS g) WHERE f.idle < 5)
"""


@query("train_best_checkpoint", "WITH RECURSIVE " + _HISTORY + "SELECT run, arg_max(best, epoch) AS best_epoch FROM f GROUP BY run")
def best_checkpoint(spark, sf_dir):
    return S.best_checkpoint(_history(spark, sf_dir)).select("run", "best_epoch")


@query("train_early_stop", "WITH RECURSIVE " + _HISTORY + "SELECT run, max(epoch) AS last_epoch FROM f GROUP BY run")
def early_stop(spark, sf_dir):
    return S.best_checkpoint(_history(spark, sf_dir)).select("run", "last_epoch")


@query("manifest_last_wins", "SELECT CAST(user_id AS VARCHAR) || '.png' AS filename, arg_max(event_type, event_id) AS label, arg_max(value, event_id) AS score FROM events GROUP BY 1")
def manifest_last_wins(spark, sf_dir):
    """Two appends of the events, the later half of each user's last: an append wins over what was there."""
    e = table(spark, sf_dir, "events")
    late = F.col("event_id") % 2 == F.max("event_id").over(Window.partitionBy("user_id")) % 2
    ordinal = F.struct(F.when(late, 1).otherwise(0).alias("append"), F.col("event_id").alias("line"))
    return M.last_wins(e.select(ordinal.alias("ord"), F.concat(F.col("user_id").cast("string"), F.lit(".png")).alias("filename"), F.col("event_type").alias("label"), F.col("value").alias("score")))


def _images(spark, sf_dir):
    return index(spark, sf_dir).select(F.col("path").alias("filename"), F.col("label").alias("folder"), "doc_id")


def _manifest(spark, sf_dir):
    return index(spark, sf_dir).filter("doc_id % 3 <> 0 AND label <> 'map'").select(F.col("path").alias("filename"), (F.col("doc_id") % 97).alias("page"))


@query("manifest_join_images", W + "SELECT path AS filename, label AS folder, CASE WHEN doc_id % 3 <> 0 AND label <> 'map' THEN doc_id % 97 END AS page, doc_id % 3 <> 0 AND label <> 'map' AS in_manifest FROM idx")
def manifest_join_images(spark, sf_dir):
    return M.join_images(_images(spark, sf_dir), _manifest(spark, sf_dir)).drop("doc_id")


@query("manifest_pairing_status", W + """, c AS (SELECT label, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0 AND label <> 'map') AS m FROM idx GROUP BY label)
SELECT label AS folder, CASE WHEN label_id % 5 = 0 THEN 'none' WHEN label_id % 5 = 1 THEN 'missing' WHEN label_id % 5 = 2 THEN 'outside' WHEN coalesce(n, 0) > 0 AND m = 0 THEN 'no_match' ELSE 'ok' END AS status,
  CASE WHEN label_id % 5 > 2 AND n > 0 THEN m END AS matched, CASE WHEN label_id % 5 > 2 AND n > 0 THEN n ELSE 0 END AS checked FROM tax LEFT JOIN c USING (label)""")
def manifest_pairing_status(spark, sf_dir):
    from plumbline.functions import taxonomy as tax

    k = F.col("label_id") % 5
    folders = tax.dimension(spark).select(F.col("label").alias("folder"), F.lit("/data/a").alias("root"), F.when(k != 0, F.lit("/data/a/manifest.jsonl")).alias("manifest_path"), F.when(k == 2, F.lit("/data/b")).otherwise(F.lit("/data/a")).alias("manifest_dir"), (k != 1).alias("exists"))
    return M.pairing_status(folders, _images(spark, sf_dir), _manifest(spark, sf_dir))


#: Folders of some moves: escapes, and names that JSON or a replacement pattern must quote.
_ODD = {14: "../x", 22: "/abs", 26: "c$1", 34: 'q"z', 38: "a..b", 46: "./back\\slash", 58: "map/../odd"}
_ODD_SQL = "CASE " + " ".join(f"WHEN doc_id % {k} = 0 THEN '{v}'" for k, v in _ODD.items())
#: One file name in nine holds two dots.
_FILE = "CASE WHEN doc_id % 9 = 4 THEN 'a..b' || path ELSE path END"


def _file():
    return F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("a..b"), "path")).otherwise(F.col("path"))


def _files(spark, sf_dir):
    return index(spark, sf_dir).select(_file().alias("file"), F.col("label").alias("folder"))


def _moves(spark, sf_dir):
    """Two moves a file at most: by label to the next label's folder, some of them idle or wrong."""
    from plumbline.functions import taxonomy as tax

    i = index(spark, sf_dir).join(F.broadcast(tax.dimension(spark)), "label")
    to = lambda d: tax.label_at((F.col("label_id") + d) % tax.K)
    goal = to(1)
    for k, folder in reversed(_ODD.items()):
        goal = F.when(F.col("doc_id") % k == 0, F.lit(folder)).otherwise(goal)
    one = i.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("ord"), _file().alias("file"), F.when(F.col("doc_id") % 10 == 0, to(3)).otherwise(F.col("label")).alias("from"), goal.alias("to"))
    two = i.filter("doc_id % 4 = 0").select((F.col("doc_id") + 10_000_000).alias("ord"), _file().alias("file"), to(1).alias("from"), F.when(F.col("doc_id") % 12 == 0, to(1)).otherwise(to(2)).alias("to"))
    return one.unionByName(two)


_REPORT = f""",
m1 AS (SELECT i.doc_id AS ord, {_FILE} AS file, CASE WHEN doc_id % 10 = 0 THEN t3.label ELSE i.label END AS f, {_ODD_SQL} ELSE t1.label END AS t, i.label AS home, t1.label AS next, doc_id FROM idx i JOIN tax t0 ON t0.label = i.label JOIN tax t1 ON t1.label_id = (t0.label_id + 1) % 13 JOIN tax t3 ON t3.label_id = (t0.label_id + 3) % 13 WHERE doc_id % 2 = 0),
r1 AS (SELECT *, CASE WHEN t IN ('../x', '/abs') THEN 'path escapes root' WHEN f <> home THEN 'source file missing' END AS reason FROM m1),
m2 AS (SELECT i.doc_id + 10000000 AS ord, {_FILE} AS file, t1.label AS f, t2.label AS t, doc_id FROM idx i JOIN tax t0 ON t0.label = i.label JOIN tax t1 ON t1.label_id = (t0.label_id + 1) % 13 JOIN tax t2 ON t2.label_id = (t0.label_id + 2) % 13 WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0),
r2 AS (SELECT m2.*, CASE WHEN r1.reason IS NOT NULL OR r1.t <> r1.next THEN 'source file missing' END AS reason FROM m2 JOIN r1 USING (doc_id)),
rep AS (SELECT ord, file, f AS "from", t AS "to", reason IS NULL AS moved, reason FROM r1 UNION ALL SELECT ord, file, f, t, reason IS NULL, reason FROM r2)
"""


@query("commit_moves", W + _REPORT + "SELECT * FROM rep")
def commit_moves(spark, sf_dir):
    return M.commit_moves(_moves(spark, sf_dir), _files(spark, sf_dir))


#: Lines of a manifest: broken ones, and some with an old ``manual_root`` in the middle.
_OLD = '"manual_root": "o\\"ld", '


@query("commit_patch_manifest", W + _REPORT + f""", d AS (SELECT file, arg_max("to", ord) AS dst FROM rep WHERE moved GROUP BY file),
l AS (SELECT doc_id, {_FILE} AS path, doc_id % 5 = 1 AS old FROM idx),
v AS (SELECT doc_id AS ord, path, old, '{{"filename": "' || path || '", ' AS head, '"page": ' || (doc_id % 97) AS page FROM l),
q AS (SELECT v.*, dst, '"manual_root": "' || replace(replace(dst, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS root FROM v LEFT JOIN d ON path = file)
SELECT ord, CASE WHEN ord % 11 = 0 THEN 'broken line' WHEN dst IS NULL THEN head || CASE WHEN old THEN '{_OLD}' ELSE '' END || page || '}}' WHEN old THEN head || root || ', ' || page || '}}' ELSE head || page || ', ' || root || '}}' END AS value,
  dst IS NOT NULL AND ord % 11 <> 0 AS touched FROM q""")
def commit_patch_manifest(spark, sf_dir):
    rep = M.commit_moves(_moves(spark, sf_dir), _files(spark, sf_dir))
    old = F.when(F.col("doc_id") % 5 == 1, F.lit(_OLD)).otherwise("")
    value = F.when(F.col("doc_id") % 11 == 0, F.lit("broken line")).otherwise(F.concat(F.lit('{"filename": "'), _file(), F.lit('", '), old, F.lit('"page": '), (F.col("doc_id") % 97).cast("string"), F.lit("}")))
    return M.patch_manifest(index(spark, sf_dir).select(F.col("doc_id").alias("ord"), value.alias("value")), rep)


@query("commit_no_record", W + _REPORT + f"SELECT DISTINCT file FROM rep WHERE moved AND file NOT IN (SELECT {_FILE} FROM idx WHERE doc_id % 3 <> 0 AND label <> 'map')")
def commit_no_record(spark, sf_dir):
    known = index(spark, sf_dir).filter("doc_id % 3 <> 0 AND label <> 'map'").select(_file().alias("filename"))
    return M.moved_without_record(M.commit_moves(_moves(spark, sf_dir), _files(spark, sf_dir)), known)
