"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are maximal runs of a class's characters.  A window slides over a candidate; its
character counts change by one character in and one out, and the sum of c*log2(c) with them, so a
candidate of any length costs one step a character.  Windows at or above the class's threshold are
united into spans.  The allow-list suppresses candidates that are known to be harmless; it acts on
the spans of the method only, never on those of the fixed patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: The patterns of the base kinds; group 2, the match and the match are what is measured.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")


@dataclass(frozen=True)
class CharClass:
    """A character class: its candidates, window, entropy threshold in bits, and the kinds of
    characters that a window of a real key mixes."""

    kind: str
    candidates: re.Pattern
    window: int
    bits: float
    mixed: tuple[frozenset, ...]


_LOWER, _UPPER, _DIGIT = frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("0123456789")
CLASSES = (
    CharClass("entropy_hex", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])"), 20, 3.0, (_DIGIT, frozenset("abcdefABCDEF"))),
    CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9, (_LOWER, _UPPER, _DIGIT)),
    CharClass("entropy_lower", re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{24,}(?![A-Za-z0-9])"), 24, 3.7, (_LOWER, _DIGIT)),
    CharClass("entropy_upper", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{24,}(?![A-Za-z0-9])"), 24, 3.7, (_UPPER, _DIGIT)),
)

#: Candidates that as a whole are no secrets: UUIDs, paths and identifiers made of plain words.
ALLOW = (
    re.compile(r"(?i)\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z"),
    re.compile(r"\A[/_=-]*(?:[A-Za-z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]+|[0-9]+))*[/_=+-]*\Z"),
)
#: Placeholders and alphabets: the letters and digits around one are no secret, nor is a span that
#: follows one with one or two other characters between.
_PLACEHOLDER = "example|sample|placeholder|dummy|changeme|x{6}|0{8}|abcdefgh|0123456789|qwertyui"
ALLOW_PART = re.compile(rf"(?i)[a-z0-9]*(?:{_PLACEHOLDER})[a-z0-9]*")
ALLOW_BEFORE = re.compile(rf"(?i)(?:{_PLACEHOLDER})[^a-z0-9]{{1,2}}\Z")
_LOOK_BACK = len("placeholder") + 2

_CLOG = [0.0, *[c * math.log2(c) for c in range(1, 257)]]


def entropy_windows(text: str, window: int, bits: float, mixed: tuple[frozenset, ...] = ()) -> Iterator[tuple[int, int]]:
    """United spans of the windows of ``text`` with at least ``bits`` of entropy that hold a
    character of each of ``mixed``; counts move by one character in and one out."""
    n = len(text)
    if n < window:
        return
    counts: dict[str, int] = {}
    kinds = [0] * len(mixed)
    total, most = 0.0, (math.log2(window) - bits) * window + 1e-9  # entropy >= bits as sum c*log2(c) <= most
    start = end = -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOG[c + 1] - _CLOG[c]
        for k, group in enumerate(mixed):
            kinds[k] += ch in group
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOG[c - 1] - _CLOG[c]
            for k, group in enumerate(mixed):
                kinds[k] -= old in group
        if i >= window - 1 and total <= most and all(kinds):
            at = i - window + 1
            if at > end:
                if start >= 0:
                    yield start, end
                start = at
            end = i + 1
    if start >= 0:
        yield start, end


def allowed(candidate: str) -> bool:
    return any(p.search(candidate) for p in ALLOW)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans); the method's spans inside a base span, or one of an earlier class, are
    that one's.  An empty text has none."""
    base = base_spans(text)
    more: list[tuple[int, int, int]] = []
    for cls in CLASSES:
        number, held = KINDS.index(cls.kind), base + more
        for m in cls.candidates.finditer(text):
            if not allowed(m[0]):
                spans = [(m.start() + s, number, m.start() + e) for s, e in _windows(m[0], cls) if s or not ALLOW_BEFORE.search(text, max(0, m.start() - _LOOK_BACK), m.start())]
                more += [x for x in spans if not any(s <= x[0] and x[2] <= e for s, _, e in held)]
    return base, sorted(base + more)


def _windows(candidate: str, cls: CharClass) -> Iterator[tuple[int, int]]:
    """Spans of a candidate, of its parts between placeholders where it holds any."""
    at = 0
    for m in [*ALLOW_PART.finditer(candidate), None]:
        end = m.start() if m else len(candidate)
        yield from ((at + s, at + e) for s, e in entropy_windows(candidate[at:end], cls.window, cls.bits, cls.mixed))
        at = m.end() if m else end


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind, value) in code points, for every row.

    Null and empty texts have empty arrays."""
    common.prepare(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches):
        for b in batches:
            base, full = [], []
            for t in b.column(1).to_pylist():
                x, y = find(t or "")
                base.append([(s, e, KINDS[k], t[s:e]) for s, k, e in x])
                full.append([(s, e, KINDS[k], t[s:e]) for s, k, e in y])
            as_dicts = [[[dict(zip(("start", "end", "kind", "value"), r, strict=True)) for r in rows] for rows in col] for col in (base, full)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, arrow) for c in as_dicts]], names=["doc_id", "base", "spans"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("base", span), T.StructField("spans", span)]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op 1, for every row; null and empty texts have no spans."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [find(t or "") for t in b.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([written(full) for _, full in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
