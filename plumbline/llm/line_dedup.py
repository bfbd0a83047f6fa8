"""Line dedup over levelled sorted runs of line hashes.

The store is a log-structured merge tree of runs in the shared folder.  A run is bucketed and sorted by
the 128-bit hash of a line's key.  A new batch is reduced to one row a key, (documents, largest id),
and merge-anti-joined with the runs: what no run has is fresh and becomes a run of level 0; the others
only add to a key that some run has and are written apart, as additions.  So a key is in one run, once,
whatever the number of batches.  When a level holds ``fanout`` runs they are compacted into one run of
the next level.  A key's totals are its run's row and the sum of its additions; most lines are seen
once and are in a run only.  Totals are the same however batches are cut, provided a document is in one
batch: batches are dealt by the hash of doc_id.

All runs and additions have the same buckets, and a batch is shuffled to them once: the anti-join, the
compaction and the totals merge bucket with bucket and move nothing.

Skew.  A line's documents are counted by (key, doc) first and then by key with map-side partial
sums, so a line that a third of all documents hold is no large group.  Up to ``FEW_KEYS`` common keys
are broadcast and every text is cut where it stands.  Beyond that, the join that marks their documents
is a plain equi-join that adaptive execution may split, and the marks meet the texts in a merge join,
which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 2
#: Lines of a bucket of the runs, where buckets are not bounded by the shuffle partitions.
BUCKET_LINES = 250_000
#: Common keys that are broadcast (some 30 MB in a worker); more go through joins.
FEW_KEYS = 200_000
_KEY = ["h1", "h2"]


def _key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc): the distinct keys of ``min_chars`` code points or more in each row's text."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(common.as_bytes(b.column(1))):
                own = {_key(x, min_chars) for x in text.split(b"\n")} if text else set()
                own.discard(None)
                keys.extend(own)
                rows.extend([i] * len(own))
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(pa.array(rows, pa.int32()))], names=["h1", "h2", "doc"])

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", kind)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, last_doc), a key in one run at most, and additions to
    them.  An empty store has no keys; null documents count as one, and come before all others.

    ``buckets`` are as many as ``lines`` expected ask for, the session's shuffle partitions at most.
    Runs are tables of the session's catalog, by random names, over files in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, lines: int | None = None) -> None:
        self.spark, self.fanout, self.levels, self.additions = spark, fanout, [], []
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = most if lines is None else max(1, min(most, -(-lines // BUCKET_LINES)))
        # An empty run, which the first batch meets: so it too is dealt to the buckets.
        empty = spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long, fresh boolean")
        self.empty = self._write(empty)

    def _write(self, rows: DataFrame) -> str:
        """Write (keys, n_docs, last_doc, fresh): fresh rows make a run, the others additions."""
        path = common.new_path(self.spark, "run")
        rows.write.partitionBy("fresh").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).format("parquet").option("path", path).saveAsTable(common.table_name(path))
        return path

    def _rows(self, path: str, fresh: bool) -> DataFrame:
        rows = self.spark.table(common.table_name(path))
        return rows.filter("fresh" if fresh else "NOT fresh").select(*_KEY, "n_docs", "last_doc")

    def runs(self) -> list[DataFrame]:
        return [self._rows(path, True) for level in self.levels for path in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch (h1, h2, doc) in; returns its fresh rows, read from their run."""
        batch = lines.groupBy(*_KEY).agg(F.count_distinct(F.coalesce(F.col("doc").cast("string"), F.lit(""))).alias("n_docs"), F.max("doc").alias("last_doc"))
        known = []
        for k, run in enumerate(self.runs() or [self._rows(self.empty, True)]):
            known.append(f"__known{k}")
            batch = batch.join(run.select(*_KEY, F.lit(True).alias(known[-1])).hint("merge"), _KEY, "left")
        fresh = F.lit(True)
        for k in known:
            fresh = fresh & F.col(k).isNull()
        first = not self.levels
        path = self._write(batch.select(*_KEY, "n_docs", "last_doc", fresh.alias("fresh")))
        self.additions += [] if first else [path]
        self._push(path, 0)
        return self._rows(path, True)

    def _push(self, path: str, level: int) -> None:
        """A run takes its place in a level; a full level is compacted into a run of the next."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(path)
        old = self.levels[level]
        if len(old) >= self.fanout:
            # Keys are in one run only, so that a merge brings rows together and adds nothing up.
            merged = self._union(old, True).groupBy(*_KEY).agg(F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self.levels[level] = []
            new = self._write(merged.withColumn("fresh", F.lit(True)))
            for x in old if level else []:  # level 0 holds the additions too
                common.drop(self.spark, x)
            self._push(new, level + 1)

    def _union(self, paths: list[str], fresh: bool) -> DataFrame:
        out = self._rows(paths[0], fresh)
        for path in paths[1:]:
            out = out.union(self._rows(path, fresh))
        return out

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) over all batches, a key once."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        if len(self.additions) > 1:
            added = self._union(self.additions, False).groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self.additions = [self._write(added.withColumn("fresh", F.lit(False)))]
        if self.additions:
            added = self._rows(self.additions[0], False).select(*_KEY, F.col("n_docs").alias("more"), F.col("last_doc").alias("later")).hint("merge")
            both = (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc")
            runs = [run.join(added, _KEY, "left").select(*_KEY, *both) for run in runs]
        out = runs[0]
        for run in runs[1:]:
            out = out.union(run)
        return out


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """The written (h1, h2, doc, part) of ``docs``; ``part`` is the batch of a document, and a file's
    rows are in its order, so that a batch reads its own pages only."""
    part = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    return common.materialize(line_hashes(docs, min_chars).withColumn("part", part).sortWithinPartitions("part"), "lines")


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The written (h1, h2, last_doc) of the keys that ``min_docs`` documents or more hold.

    Documents are told apart by doc_id (rows that share one are one document; null ids together are
    one, the smallest)."""
    store = LineRuns(lines.sparkSession, fanout, lines.count())
    for k in range(batches):
        store.add(lines.filter(F.col("part") == k))
    return common.materialize(store.totals().filter(F.col("n_docs") >= min_docs).select(*_KEY, "last_doc"), "common")


def _digest_of(h1: int, h2: int) -> bytes:
    return h1.to_bytes(8, "little", signed=True) + h2.to_bytes(8, "little", signed=True)


def _drops(docs: DataFrame, min_chars: int, min_docs: int, few: int) -> tuple[DataFrame, object]:
    """Where the keys that make a line go are: broadcast, {key: id of the document that keeps it}, with
    ``docs`` as they are, or with more than ``few`` keys None, and ``docs`` with ``__pl_drops``, the
    keys that a document loses."""
    lines = lines_of(docs.select("doc_id", "text"), min_chars)
    keys = common_lines(lines, min_docs)
    if keys.count() <= few:
        held = {_digest_of(r["h1"], r["h2"]): r["last_doc"] for r in keys.collect()}
        return docs.withColumn("__pl_drops", F.lit(None).cast("array<struct<h1:bigint,h2:bigint>>")), docs.sparkSession.sparkContext.broadcast(held)
    hit = lines.join(keys, _KEY).filter(~F.col("doc").eqNullSafe(F.col("last_doc")))
    drops = hit.groupBy("doc").agg(F.collect_set(F.struct(*_KEY)).alias("__pl_drops")).withColumnRenamed("doc", "__pl_doc")
    return docs.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__pl_doc")), "left").drop("__pl_doc"), None


def _rebuild(text: bytes | None, doc, drops, keepers: dict | None, min_chars: int) -> tuple[bytes, int, int]:
    """A text without the lines it loses, its lines, and how many it loses."""
    lines = (text or b"").split(b"\n")
    if keepers is None:
        gone = {_digest_of(x["h1"], x["h2"]) for x in drops or ()}
        kept = [x for x in lines if _key(x, min_chars) not in gone] if gone else lines
    else:
        kept = [x for x in lines if keepers.get(_key(x, min_chars), doc) == doc] if keepers else lines
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, few: int = FEW_KEYS) -> DataFrame:
    """``docs`` with repeated lines removed from ``text`` (``n_chars`` follows, where it is a column).

    Every row stays, with all its columns whatever their names; a text that loses all its lines becomes
    empty; null stays null."""
    common.prepare(docs.sparkSession)
    # Own names while the operator works: no column of the input can clash with a helper's.
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names).withColumnsRenamed({at["doc_id"]: "doc_id", at["text"]: "text"})
    joined, keepers = _drops(own, min_chars, min_docs, few)

    @F.arrow_udf(T.StringType())
    def kept(doc: pa.Array, text: pa.Array, drops: pa.Array) -> pa.Array:
        held = None if keepers is None else keepers.value
        rows = zip(doc.to_pylist(), common.as_bytes(text), drops.to_pylist(), strict=True)
        out = [None if t is None else _rebuild(t, i, d, held, min_chars)[0] for i, t, d in rows]
        return pa.array(out, pa.binary()).cast(pa.string())

    out = joined.withColumn("text", kept("doc_id", "text", "__pl_drops"))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c if c in ("doc_id", "text") else at[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, few: int = FEW_KEYS) -> DataFrame:
    """The contract's columns of op 8."""
    common.prepare(docs.sparkSession)
    joined, keepers = _drops(docs.select("doc_id", "text"), min_chars, min_docs, few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if keepers is None else keepers.value
        for b in batches:
            texts = zip(b.column(0).to_pylist(), common.as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)
            rows = [(hashlib.sha256(text).hexdigest(), n, k) for text, n, k in (_rebuild(t, i, d, held, min_chars) for i, t, d in texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.select("doc_id", "text", "__pl_drops").mapInArrow(run, schema)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
