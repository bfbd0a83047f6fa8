"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over token windows.

Each benchmark item becomes windows of ``window`` consecutive normalised words (a shorter item is
one window).  The driver numbers the items' words and keeps, as packed arrays, the items' word numbers
and of every distinct window a 64-bit polynomial hash, a place where it stands, and its items: some 40
bytes a word.  That index is broadcast.  A task numbers a document's words with the same vocabulary,
hashes only windows whose words are all known, looks the hashes up in the sorted set, and verifies each
hit against the window's word numbers, so a hash collision is never a hit.  Hits mark words; the caller
drops documents or cuts the marked spans.

Size.  The broadcast is bounded: the benchmark's words are counted first, and beyond ``block_words``
its items are divided into blocks whose indexes are separate broadcasts; a task holds one at a time
and runs groups of texts against each, so any benchmark size is exact.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Words of the benchmark whose index is one broadcast (60 MB or less but for odd vocabularies).
BLOCK_WORDS = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of texts that are scanned together, with one block of the benchmark and with several.
_BATCH_BYTES, _BLOCKS_BATCH_BYTES = 8 << 20, 64 << 20


class WindowIndex:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        self.ids: list[str] = []
        words, starts, sizes, owner = array("i"), [], [], []
        for item_id, text in items:
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in common.alnum_words(text)]
            if own:
                starts.append(len(words))
                sizes.append(len(own))
                owner.append(-1 if item_id is None else len(self.ids))
                self.ids += [] if item_id is None else [item_id]
                words.extend(own)
        self.words = np.array(words, np.int32)
        starts, sizes, owner = (np.array(x, np.int64) for x in (starts, sizes, owner))
        self.sets = {}
        for size in np.unique(np.minimum(sizes, window)).tolist():
            pick = np.minimum(sizes, window) == size
            n = sizes[pick] - size + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[pick], n)
            self.sets[size] = self._pack(size, at, np.repeat(owner[pick], n).astype(np.int32))

    def _pack(self, size: int, at: np.ndarray, owner: np.ndarray):
        """Of windows at ``at``: the hash base, sorted distinct hashes, a place of each, and where its
        owners begin in the list of all owners."""
        base = np.uint64(0x9E3779B97F4A7C15)
        while True:
            h = hash_windows([self.words[at + j] for j in range(size)], base)
            order = np.lexsort((owner, h))
            h, place, own = h[order], at[order], owner[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            head = place[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            if all((self.words[place + j] == self.words[head + j]).all() for j in range(size)):
                break
            base = base * np.uint64(6364136223846793005) + np.uint64(2)  # two windows collide
        named = (own >= 0) & (first | np.concatenate(([True], own[1:] != own[:-1])))
        cuts = np.concatenate(([0], np.cumsum(named)))[np.append(np.flatnonzero(first), len(h))]
        return base, h[first], place[first], cuts, own[named]


def hash_windows(columns, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2^64; ``columns[j]`` holds the j-th word number of every window."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for col in columns:
            h = h * base + col.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return h


def scan(texts: list[bytes | None], index: WindowIndex) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """Per text: its word count, the numbers of its hit words, and the items that occur in it."""
    get, ids, sizes = index.vocab.get, [], []
    for text in texts:
        words = common.alnum_words(text)
        ids.extend([get(w, 0) for w in words])
        ids.append(0)
        sizes.append(len(words))
    flat = np.array(ids, np.int64)
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    unknown = np.concatenate(([0], np.cumsum(flat == 0)))
    cover, found = np.zeros(len(flat) + 1, np.int64), [set() for _ in texts]
    for size, (base, hashes, place, cuts, owners) in index.sets.items():
        if len(flat) < size:
            continue
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        if not len(at):
            continue
        columns = [flat[at + j] for j in range(size)]
        h = hash_windows(columns, base)
        pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[pos] == h
        for j in range(size):
            hit &= columns[j] == index.words[place[pos] + j]
        at, pos = at[hit], pos[hit]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        for doc, p in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), pos.tolist(), strict=True)):
            found[doc].update(index.ids[k] for k in owners[cuts[p] : cuts[p + 1]].tolist())
    marked = np.cumsum(cover)[:-1] > 0
    words_hit = [np.flatnonzero(marked[starts[i] : starts[i] + n]) for i, n in enumerate(sizes)]
    return sizes, words_hit, found


def cut(text: bytes, words_hit: np.ndarray) -> bytes:
    """``text`` without the marked words and what stands between two marked neighbours."""
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for run in np.split(words_hit, np.flatnonzero(np.diff(words_hit) != 1) + 1):
        if len(run):
            out.append(text[at : spans[run[0]][0]])
            at = spans[run[-1]][1]
    return b"".join([*out, text[at:]])


def _indexes(benchmark: DataFrame, window: int, block_words: int):
    """Broadcast indexes of the benchmark, each over items of about ``block_words`` words at most."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    words = F.regexp_count(benchmark["text"], F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    size = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    out = []
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()]
        out.append(spark.sparkContext.broadcast(WindowIndex(items, window)))
    return out


def _scan_blocks(texts: list[bytes | None], indexes) -> Iterator[tuple[int, int, list[int], list[np.ndarray], list[set[str]]]]:
    """(first text, behind the last, and what ``scan`` says of them against all blocks) by groups of
    texts, with one block in memory at a time."""
    for at, to in common.byte_groups(texts, _BATCH_BYTES if len(indexes) == 1 else _BLOCKS_BATCH_BYTES):
        sizes, hits, found = None, None, None
        for bc in indexes:
            n, h, f = [], [], []
            for s, e in common.byte_groups(texts[at:to], _BATCH_BYTES):
                for own, all_of in zip(scan(texts[at + s : at + e], bc.value), (n, h, f), strict=True):
                    all_of.extend(own)
            if sizes is None:
                sizes, hits, found = n, h, f
            else:
                hits = [np.union1d(a, b) if len(b) else a for a, b in zip(hits, h, strict=True)]
                found = [a | b for a, b in zip(found, f, strict=True)]
            if len(indexes) > 1:
                vars(bc).pop("_value", None)  # a worker keeps what it has read of a broadcast
        yield at, to, sizes, hits, found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cleaned: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, [clean_text]) for every row of ``docs``.

    Null text has no words (clean text null).  Items with null or repeated ids count as windows;
    ``items`` lists distinct non-null ids, sorted as strings.  An empty benchmark hits nothing."""
    common.prepare(docs.sparkSession)
    indexes = _indexes(benchmark, window, block_words)

    def rows_of(ids, texts, sizes, hits, found):
        items = [sorted(x) for x in found]
        cols = [ids, pa.array(sizes, pa.int64()), pa.array([len(x) for x in hits], pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string()))]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items"]
        if cleaned:
            cols.append(pa.array([None if t is None else (cut(t, h) if len(h) else t).decode() for t, h in zip(texts, hits, strict=True)], pa.string()))
            names.append("clean_text")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.as_bytes(b.column(1))
            for at, to, *found in _scan_blocks(texts, indexes):
                yield rows_of(b.column(0)[at:to], texts[at:to], *found)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")], T.StructField("items", T.ArrayType(T.StringType()))]
    if cleaned:
        fields.append(T.StructField("clean_text", T.StringType()))
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; all columns.

    Every row is judged by its own text, where it stands: nothing is shuffled.  Null texts stay."""
    common.prepare(docs.sparkSession)
    indexes = _indexes(benchmark, window, block_words)

    @F.arrow_udf(T.BooleanType())
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([len(h) == 0 for _, _, _, hits, _ in _scan_blocks(common.as_bytes(text), indexes) for h in hits], pa.bool_())

    return docs.filter(clean("text"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of op 3."""
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
