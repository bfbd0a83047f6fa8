"""Byte-level BPE by speculation and verification, and its decoder.

A text is cut into words by the pre-tokenizer's pattern.  For words not seen before, greedy
longest-match over the vocabulary proposes tokens.  One vectorised check then tests every adjacent
pair of proposed tokens: the two tokens' merge trees are taken apart again in reverse order of their
merges, and if at any moment the two neighbours across the seam could have merged earlier than they
were merged into what stands there, the pair is not what BPE makes.  A sequence of which all pairs
pass is the BPE encoding; only words with a failing pair are merged exactly, by rank.  Words repeat,
so each worker keeps a bounded table of finished words.

The tokenizer's file is a parameter; the driver reads it and broadcasts it (its size is checked).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: The byte-level pre-tokenizer's pattern, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MAX_FILE = 64 << 20
#: Finished words that a worker keeps, and their bytes with what they became.
_KEPT_WORDS, _KEPT_BYTES = 300_000, 96 << 20
_GROUP_CHARS = 2 << 20
_NEVER = np.int64(1 << 40)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Slots:
    """Position of a key in a fixed key list, by two multiplicative hash tables; else _NEVER."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 16).bit_length())
        self.shift, self.tables = np.uint64(64 - bits), []
        left, mult = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            key, pos = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int64)
            at = self._slot(keys[left], mult)
            key[at], pos[at] = keys[left], left
            self.tables.append((mult, key, pos))
            left = left[pos[at] != left]
            mult = (mult * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1

    def _slot(self, keys: np.ndarray, mult: int) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(mult) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NEVER, np.int64)
        for mult, key, pos in self.tables:
            at = self._slot(keys, mult)
            hit = key[at] == keys
            out[hit] = pos[at[hit]]
        return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        chars = _byte_chars()
        vocab = {bytes(chars[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.vocab = vocab
        size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.pieces[i] = s
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.decimal = [b"%d" % i for i in range(size)]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words_any, self.words_ascii = regex.compile(_PATTERN).findall, re.compile(_ASCII).findall
        self.rank: dict[tuple[int, int], int] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.made = np.full(size, -1, np.int64)  # the rank at which a token arises; bytes: -1
        self.product = np.zeros(len(spec["model"]["merges"]), np.int64)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = (bytes(chars[c] for c in x) for x in (a, b))
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank[i, j] = r
            self.product[r] = k
            self.left[k], self.right[k], self.made[k] = i, j, r
        keys = np.array([i << 20 | j for i, j in self.rank], np.int64)
        self.slots = _Slots(keys)
        self.byte_ids = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.longest: dict[bytes, int] = {}  # by the first four bytes
        for s in vocab:
            if len(s) > 3:
                self.longest[s[:4]] = max(self.longest.get(s[:4], 0), len(s))
        self.done: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest-match from the left."""
        vocab, longest, out, at, n = self.vocab, self.longest, [], 0, len(word)
        while at < n:
            for size in range(min(longest.get(word[at : at + 4], 3), n - at), 0, -1):
                if (t := vocab.get(word[at : at + size])) is not None:
                    out.append(t)
                    at += size
                    break
            else:
                raise ValueError(f"no token for byte {word[at]}")
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE makes exactly a[i], b[i] of their joint bytes."""
        ok = np.ones(len(a), bool)
        x, y, where = a.copy(), b.copy(), np.arange(len(a))
        later_x, later_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(where):
            r = self.slots.find(x << 20 | y)
            # Equal ranks go from left to right: the seam's merge comes after one on its left, before one on its right.
            clash = (r < later_x) & (r <= later_y) & (r < _NEVER)
            ok[where[clash]] = False
            mx, my = self.made[x], self.made[y]
            go = ~clash & ((mx >= 0) | (my >= 0))
            x, y, where, later_x, later_y, mx, my = (v[go] for v in (x, y, where, later_x, later_y, mx, my))
            undo_x = mx > my
            later_x, later_y = np.where(undo_x, mx, later_x), np.where(undo_x, later_y, my)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the lowest rank, the leftmost of equals."""
        rank, product = self.rank, self.product
        parts = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        if len(parts) <= 48:
            while len(parts) > 1:
                best = min((rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == 1 << 40:
                    break
                parts[best[1] : best[1] + 2] = [int(product[best[0]])]
            return parts
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = int(product[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (parts[i], parts[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            h = before[i]
            if h >= 0 and (p := (parts[h], parts[i])) in rank:
                heapq.heappush(heap, (rank[p], h, *p))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        found = [self.propose(w) for w in raw]
        flat = np.array([t for f in found for t in f], np.int64)
        sizes = np.array([len(f) for f in found], np.int64)
        if len(flat) < 2:
            return found
        owner = np.repeat(np.arange(len(found)), sizes)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[seam[~self.compatible(flat[seam], flat[seam + 1])]])
        by_size: dict[int, list[int]] = {}
        for i in bad.tolist():
            if len(raw[i]) > 48:
                found[i] = self.merge(raw[i])
            else:
                by_size.setdefault(len(raw[i]), []).append(i)
        for size, rows in by_size.items():
            for i, ids in zip(rows, self._merge_all(b"".join([raw[i] for i in rows]), size), strict=True):
                found[i] = ids
        return found

    def _merge_all(self, joined: bytes, size: int) -> list[list[int]]:
        """``merge`` for many words of one length, a merge of each word at a time."""
        ids = self.byte_ids[np.frombuffer(joined, np.uint8)].reshape(-1, size)
        out: list = [None] * len(ids)
        rows, end = np.arange(len(ids)), np.full(len(ids), size)
        rank = np.full(ids.shape, _NEVER, np.int64)
        rank[:, :-1] = self.slots.find((ids[:, :-1] << 20 | ids[:, 1:]).ravel()).reshape(len(ids), -1)
        while len(rows):
            at = rank.argmin(1)
            k = np.arange(len(rows))
            low = rank[k, at]
            over = low == _NEVER
            if over.any():
                for r, n, x in zip(rows[over].tolist(), end[over].tolist(), ids[over].tolist(), strict=True):
                    out[r] = x[:n]
                go = ~over
                rows, end, ids, rank, at, low = (v[go] for v in (rows, end, ids, rank, at, low))
                k = np.arange(len(rows))
                if not len(rows):
                    break
            cols = np.arange(ids.shape[1] - 1)
            src = cols + (cols > at[:, None])
            ids, rank = np.take_along_axis(ids, src, 1), np.take_along_axis(rank, src, 1)
            end = end - 1
            ids[k, at] = self.product[low]
            rank[k, at] = _NEVER
            right = at + 1 < end
            i, j = k[right], at[right]
            rank[i, j] = self.slots.find(ids[i, j] << 20 | ids[i, j + 1])
            left = at > 0
            i, j = k[left], at[left]
            rank[i, j - 1] = self.slots.find(ids[i, j - 1] << 20 | ids[i, j])
        return out

    def _finish(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                self.done[w] = made = (b",".join([self.decimal[i] for i in ids]), self.decode(ids))
                self.held += 200 + len(w) + len(made[0]) + len(made[1])

    def decode(self, ids) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encode_many([text]))[0].split(b",") if x]

    def encode_many(self, texts: list[str]) -> Iterator[tuple[bytes, int, bytes]]:
        """Per text: decimal ids joined by commas, their number, and the bytes they decode to.

        Texts go in groups of some characters, so that the new words of a group are encoded together."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < _GROUP_CHARS):
                size += len(texts[to])
                to += 1
            cut = [[p if p in self.special else self.words(p) for p in self._pieces(t)] for t in texts[at:to]]
            seen = {w for pieces in cut for p in pieces if not isinstance(p, str) for w in p}
            new = seen.difference(self.done)
            if len(self.done) + len(new) > _KEPT_WORDS or self.held > _KEPT_BYTES:
                self.done.clear()
                self.held, new = 0, seen
            self._finish(list(new))
            for pieces in cut:
                done = []
                for p in pieces:
                    if isinstance(p, str):
                        i = self.special[p]
                        done.append((b"%d" % i, self.pieces[i]))
                    else:
                        done.extend([self.done[w] for w in p])
                joined = b",".join([d[0] for d in done])
                yield joined, joined.count(b",") + 1 if joined else 0, b"".join([d[1] for d in done])
            at = to

    def words(self, text: str) -> list[str]:
        """The pre-tokenizer's words; pure ASCII goes through the plain engine."""
        return self.words_ascii(text) if text.isascii() else self.words_any(text)

    def _pieces(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.special and any(s in text for s in self.special) else [text]


_codecs: dict[str, Codec] = {}


def codec_of(file: bytes) -> Codec:
    """One codec per worker and file."""
    name = hashlib.sha256(file).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(file)
    return _codecs[name]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        file = f.read(MAX_FILE + 1)
    if len(file) > MAX_FILE:
        raise ValueError(f"tokenizer file above {MAX_FILE} bytes")
    return spark.sparkContext.broadcast(file)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every whole text; null and empty texts have none."""
    common.prepare(docs.sparkSession)
    file = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[int(x) for x in ids.split(b",") if x] for ids, _, _ in codec.encode_many([t or "" for t in b.column(1).to_pylist()])], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no UTF-8 become U+FFFD; null ids: null."""
    common.prepare(tokens.sparkSession)
    file = _broadcast(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("text", T.StringType())]))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns of op 6: each text is encoded, and decoded again from its tokens."""
    common.prepare(docs.sparkSession)
    file = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_of(file.value), hashlib.sha256
        for b in batches:
            rows = [(n, sha(ids).hexdigest(), sha(back.decode("utf-8", "replace").encode()).hexdigest()) for ids, n, back in codec.encode_many([(t or b"").decode() for t in common.as_bytes(b.column(1))])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
