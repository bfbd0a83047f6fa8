"""SimHash near-duplicates by a binary-trie self-join.

Method.  A text's fingerprint is the majority bit vector over XXH64 hashes of its word
shingles.  Two fingerprints within ``budget`` bits agree on at least one of ``budget + 1``
equal blocks, so each distinct fingerprint goes, rotated so that the block leads, to the group
of every block value.  In a group the sorted fingerprints *are* a binary trie (a node is a
range); pairs of nodes are walked down together, the differing bits are summed, and a pair is
cut as soon as the sum exceeds the budget.  Budgets 1, 2, .. are tried in turn and a node pair
whose fingerprints are already connected is cut too, so a dense group of n near copies costs
about n and emits at most n - 1 links, never all its pairs, while connectivity stays exact.
Links become components by alternating large-star / small-star rounds, each checkpointed.

Skew.  Identical fingerprints are one node.  A group above ``hot`` members is divided by a
second block inside the remaining bits (exact, for the same reason as the first), and so on, up to
``DIVISIONS`` times: the members of what is then left share 43 bits, so they are 2,097,152 at most (17
MB).  A task works on whole groups one after another and holds no more than the largest.
Links meet in the component step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 3
BUDGET = 3
HOT = 200_000
DIVISIONS = 3
#: Ids of copies that are broadcast (some 50 MB in an executor); more are joined by a shuffle.
FEW_IDS = 500_000
#: Edges of a file between two component rounds.
ROUND_EDGES = 500_000
_FLUSH = 1 << 18
_LANES = np.uint64(0x0101010101010101)
_BITS = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; no words: 0."""
    words = common.token_words(text)
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, total, k = xxhash.xxh64_intdigest, np.zeros(_BITS, np.int64), n - shingle + 1
    for at in range(0, k, 1 << 16):
        to = min(k, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)
        cuts = np.arange(0, len(h), 255)
        for bit in range(8):  # byte lanes hold up to 255 ones before they are spread
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
            total[bit::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    ones = total * 2 > k
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): ``fp`` is the signed view of the fingerprint.  Null text has no words."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Union-find over sorted leaf positions, with vectorised root look-ups."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i]: hook larger roots under smaller ones until nothing moves."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            rr = self.up[r]
            if np.array_equal(rr, r):
                return r
            self.up[x] = rr
            r = rr


def trie_links(values: np.ndarray, lead: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Connect the sorted distinct uint64 ``values`` that share their top ``lead`` bits and
    differ in at most ``budget`` of the others.  Returns positions (member, smallest member)
    of every member that is not its own component's smallest."""
    n = len(values)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    forest = _Forest(n)
    heads = values >> np.uint64(_BITS - lead) if lead else np.zeros(n, np.uint64)
    cut = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [n]))
    lo, hi = cut[:-1], cut[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(depth: int) -> np.ndarray:
        if depth not in zeros:
            bit = (values >> np.uint64(_BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0, dtype=np.int32)))
        return zeros[depth]

    for limit in range(1, budget + 1):
        stack = [(lead, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
        labels, changes = None, None
        while stack:
            depth, al, ah, bl, bh, err = stack.pop()
            if len(al) > 1 << 17:  # a narrow front keeps memory flat, and links made early cut later pairs
                for s in range(0, len(al), 1 << 17):
                    e = s + (1 << 17)
                    stack.append((depth, al[s:e], ah[s:e], bl[s:e], bh[s:e], err[s:e]))
                continue
            single = (ah - al == 1) & (bh - bl == 1)
            if single.any():
                a, b = al[single], bl[single]
                near = (a != b) & (_popcount(values[a] ^ values[b]) <= limit)
                if near.any():
                    forest.join(a[near], b[near])
                    labels = None
                al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
            if not len(al):
                continue
            if depth == _BITS:
                continue
            if labels is None:
                labels = forest.roots(np.arange(n))
                changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
            done = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (labels[al] == labels[bl])
            if done.any():
                al, ah, bl, bh, err = (x[~done] for x in (al, ah, bl, bh, err))
            z = zeros_before(depth)
            am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
            same = (al == bl) & (ah == bh)
            kids = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~same)]
            parts = []
            for cl, ch, dl, dh, e, also in kids:
                ok = (ch > cl) & (dh > dl) & (e <= limit) & ~((cl == dl) & (ch == dh) & (ch - cl == 1))
                if also is not None:
                    ok &= also
                parts.append(tuple(x[ok] for x in (cl, ch, dl, dh, e)))
            al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(al):
                stack.append((depth + 1, al, ah, bl, bh, err))
    root = forest.roots(np.arange(n))
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    by %= _BITS
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(_BITS - by))


def _leads(budget: int) -> list[int]:
    """Bits that a group shares, by how often it was divided."""
    out = [_BITS // (budget + 1)]
    while len(out) <= DIVISIONS and (_BITS - out[-1]) // (budget + 1):
        out.append(out[-1] + (_BITS - out[-1]) // (budget + 1))
    return out


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(u, v), u > v: links that connect every two distinct fingerprints of column ``fp`` within
    ``budget`` bits, as a forest per group.

    A row of a group is (turn, path, val): the fingerprint turned so that all bits that its group
    shares lead, and how: turned by ``turn``, then for each digit j + 1 of ``path`` (to the base
    ``budget`` + 2) the bits behind the shared ones turned by j blocks."""
    spark = fps.sparkSession
    leads, base = _leads(budget), budget + 2

    def turned(x, by):
        return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, _BITS - by))

    x = F.col("fp")
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(i * leads[0]).alias("turn"), F.lit(0).cast("long").alias("path"), turned(x, i * leads[0]).alias("val")) for i in range(budget + 1)])).alias("b")).select("b.*")
    done = None
    for level, lead in enumerate(leads):
        grouped = rows.withColumn("head", F.shiftrightunsigned("val", _BITS - lead))
        keyed = grouped.withColumn("key", F.xxhash64("turn", "path", "head"))
        crowded = grouped.groupBy("turn", "path", "head").count().filter(F.col("count") > hot).select("turn", "path", "head", F.lit(True).alias("crowded"))
        last = level == len(leads) - 1 or crowded.isEmpty()
        calm = keyed if last else keyed.join(crowded, ["turn", "path", "head"], "left_anti")
        calm = calm.select("turn", "path", "val", "key")
        done = calm if done is None else done.unionByName(calm)
        if last:
            break
        rest_bits, block = _BITS - lead, leads[level + 1] - lead
        mask = (1 << rest_bits) - 1
        rest = F.col("val").bitwiseAND(F.lit(mask))
        parts = []
        for j in range(budget + 1):
            by = j * block
            moved = rest if by == 0 else F.shiftleft(rest, by).bitwiseOR(F.shiftrightunsigned(rest, rest_bits - by)).bitwiseAND(F.lit(mask))
            parts.append(F.struct("turn", (F.col("path") * base + j + 1).alias("path"), F.col("val").bitwiseAND(F.lit(~mask)).bitwiseOR(moved).alias("val")))
        dense = grouped.join(crowded, ["turn", "path", "head"], "left_semi")
        rows = common.materialize(dense.select(F.explode(F.array(*parts)).alias("b")).select("b.*"), "dense")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        return _group_links(batches, leads, budget)

    return done.repartition(n, "key").sortWithinPartitions("turn", "path", "val").mapInArrow(run, "u long, v long")


def _digits(path: int, base: int) -> list[int]:
    out = []
    while path:
        path, d = divmod(path, base)
        out.append(d - 1)
    return out[::-1]


def _group_links(batches, leads: list[int], budget: int):
    """Links of the groups of a task, whose rows come in the order of (turn, path, val)."""

    def back(turn: int, digits: list[int], v: np.ndarray) -> np.ndarray:
        for level in range(len(digits) - 1, -1, -1):
            rest_bits, by = _BITS - leads[level], digits[level] * (leads[level + 1] - leads[level])
            mask = np.uint64((1 << rest_bits) - 1)
            rest = v & mask
            rest = ((rest >> np.uint64(by)) | (rest << np.uint64(rest_bits - by))) & mask if by else rest
            v = (v & ~mask) | rest
        return _rotl(v, _BITS - turn)

    def work(turn: int, path: int, v: np.ndarray):
        v, digits = np.unique(v), _digits(path, budget + 2)
        member, root = trie_links(v, leads[len(digits)], budget)
        if len(member):
            a, b = (back(turn, digits, v[x]).view(np.int64) for x in (member, root))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    kind, held, size = None, [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        turn, path, val = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = np.concatenate(([0], np.flatnonzero((turn[1:] != turn[:-1]) | (path[1:] != path[:-1])) + 1, [len(turn)]))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            own = (int(turn[s]), int(path[s]))
            if own != kind and held:
                yield from work(*kind, np.concatenate(held))
                held, size = [], 0
            kind = own
            held.append(val[s:e].view(np.uint64))
            size += e - s
            if size > _FLUSH:  # groups arrive one after another: all but the last are whole
                v = np.concatenate(held)
                heads = v >> np.uint64(_BITS - leads[len(_digits(kind[1], budget + 2))])
                other = np.flatnonzero(heads != heads[-1])
                at = int(other[-1]) + 1 if len(other) else 0
                if at:
                    yield from work(*kind, v[:at])
                held, size = [v[at:]], len(v) - at
    if held:
        yield from work(*kind, np.concatenate(held))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of ``edges`` (u, v) but each component's smallest, with that smallest."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    common.shared_dir(edges.sparkSession)
    edges = edges.checkpoint()
    size = edges.count()
    # Rounds have no more edges than twice the first: their files are as many as these ask for.
    parts = -(-2 * size // ROUND_EDGES)
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        new = pairs.select("e.*").filter("u <> v").distinct().coalesce(parts).checkpoint()
        now = new.count()
        if now == size and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges, size = new, now
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are not read).

    Null or blank text: fingerprint 0, linked like any other.  Rows that share a doc_id each get
    a row.  component_id is the smallest non-null doc_id reachable; null where all are null.
    """
    common.prepare(docs.sparkSession)
    fps = common.materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    star = components(links(nodes.select("fp"), budget)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(star, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, few: int = FEW_IDS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the smallest doc_id; all columns.

    Rows that share a doc_id are one document and stay together; null ids stay only as a group
    of their own.  Up to ``few`` ids of copies are broadcast, and no text is moved."""
    found = near_duplicates(docs, shingle, budget)
    out = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__pl_id")).distinct()
    out = common.materialize(out, "copies")
    out = F.broadcast(out) if out.count() <= few else out.hint("merge")
    return docs.join(out, docs["doc_id"].eqNullSafe(out["__pl_id"]), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op 7."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
