"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters.  A lexicon of words and word beginnings is mined from a bounded sample of the labelled documents
that are not held out (``LABELLED_DOCS``; document frequencies by class, counted in Spark): every entry
is a voter, and fixed patterns are more voters.  A voter fires or not on a text.  An entry is in
``MIN_SHARE`` of the sample's toxic documents at least: a rarer kind of toxicity has no voters of its own.
Label model.  One pass over all documents that are not held out gathers the voters' first and second
moments (a matrix of voters x voters, whatever the input's size).  Under conditional independence
the covariance of two voters is the product of their separations times the class variance, so
separations follow from triplets; pairs whose covariance departs from that are correlated, are left
out of the triplets, and share their weight.  A voter's firing rates by class follow from its mean.
Classifier.  Logistic regression with an L1 pull, on the presence of mined features, is trained on the label model's
posteriors of a bounded sample (``SAMPLE_DOCS``), and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

HELD_OUT = (5, 0)
LABELLED_DOCS = 12_000
SAMPLE_DOCS = 12_000
#: Sampled texts of a file.
FILE_DOCS = 1_000
LEXICON = 48
MIN_DOCS = 4
MIN_SHARE = 0.02
FEATURES = 3_000
DENSE = 150
#: Pattern voters, over the lowered text; {lex} is the mined lexicon.
PATTERNS = (r"\byou\s+(?:\w+\s+){{0,2}}(?:{lex})s?\b", r"\b(?:{lex})s?\s*!+", r"\b(?:such|what)\s+an?\s+(?:\w+\s+)?(?:{lex})\b")


def _crc(c: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))


def _words(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(common.ALNUM_WORDS).split()


def _dense(count: int, n: int) -> bool:
    """A chance hit is rare in its text; an insult's stem comes back."""
    return count >= 2 and count * DENSE >= n


def features(text: bytes | None) -> set[bytes]:
    """Lowered words, and their beginnings of 3 to 8 characters marked by a star; a plus marks what
    comes back densely."""
    words = _words(text)
    counts: dict[bytes, int] = {}
    for w, c in Counter(words).items():
        counts[w] = counts.get(w, 0) + c
        t = w[:36].decode("utf-8", "ignore")  # nine characters of up to four bytes
        for k in range(3, min(9, len(t))):
            stem = (t[:k] + "*").encode()
            counts[stem] = counts.get(stem, 0) + c
    return counts.keys() | {w + b"+" for w, c in counts.items() if c > 1 and _dense(c, len(words))}


class FeatureSet:
    """Finds which of some features a text has, without listing all its beginnings."""

    def __init__(self, names: list[bytes]) -> None:
        self.ids = {w: i for i, w in enumerate(names)}
        plain = {w.rstrip(b"+") for w in names}
        self.whole = {w for w in plain if not w.endswith(b"*")}
        stems = [w[:-1].decode() for w in plain if w.endswith(b"*")]
        self.stems, self.sizes = set(stems), sorted({len(s) for s in stems})
        # A word is looked at closer only if its first three characters begin some stem.
        self.heads = {s[:3] for s in stems}

    def find(self, text: bytes | None) -> list[int]:
        words = _words(text)
        own = set(words)
        known: dict[bytes, list[bytes]] = {w: [w] for w in self.whole & own}
        if self.heads:
            heads, stems = self.heads, self.stems
            for w in own:
                t = w[:36].decode("utf-8", "ignore")  # up to four bytes a character
                if t[:3] in heads:
                    for k in self.sizes:
                        if k < len(t) and t[:k] in stems:
                            known.setdefault(w, []).append((t[:k] + "*").encode())
        if not known:
            return []
        counts: dict[bytes, int] = {}
        for w in words:
            if w in known:
                for f in known[w]:
                    counts[f] = counts.get(f, 0) + 1
        found = list(counts) + [f + b"+" for f, c in counts.items() if _dense(c, len(words))]
        return sorted(self.ids[f] for f in found if f in self.ids)


class Voters:
    """The lexicon's words and beginnings, and the patterns, as one binary vote vector per text."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.lexicon = FeatureSet(lexicon)
        lex = "|".join(re.escape(w.decode().rstrip("*+")) + (r"\w*" if b"*" in w else "") for w in lexicon)
        self.patterns = [re.compile(p.format(lex=lex)) for p in PATTERNS] if lexicon else []
        self.size = len(lexicon) + len(self.patterns)

    def vote(self, text: bytes | None) -> list[int]:
        hit = self.lexicon.find(text)
        if not hit:  # every pattern holds a lexicon word
            return []
        low = text.decode().lower()
        return [*hit, *(len(self.lexicon.ids) + i for i, p in enumerate(self.patterns) if p.search(low))]


@dataclass
class LabelModel:
    """Firing rates by class, correlated pairs, the class prior, and by class the rate of no vote at all.

    A voter that does not fire abstains; voters of one language say nothing about another."""

    prior: float
    rate1: np.ndarray
    rate0: np.ndarray
    correlated: np.ndarray
    silent: tuple[float, float]

    def log_odds(self, votes: list[int]) -> float:
        start = math.log(self.prior / (1 - self.prior))
        if not votes:
            return start + math.log(self.silent[1] / self.silent[0])
        # Correlated voters that fire together share one vote.
        share = 1 / (1 + self.correlated[np.ix_(votes, votes)].sum(1))
        return start + float((share * np.log(self.rate1 / self.rate0)[votes]).sum())


def solve(n: float, fired: float, second: np.ndarray, prior: float) -> LabelModel:
    """The label model from moments: n texts, those with a vote, and the voters' joint sums."""
    m, prior = len(second), min(max(prior, 1e-4), 0.5)
    mean = np.diag(second) / max(n, 1.0)
    cov = second / max(n, 1.0) - np.outer(mean, mean)
    var = prior * (1 - prior)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    spread = np.outer(scale, scale)
    # A covariance that is hardly there says nothing about either voter.
    usable = (cov / spread > 0.05) & ~np.eye(m, dtype=bool)
    correlated = np.zeros((m, m), bool)
    sep = np.zeros(m)
    for _ in range(3):  # separations, then the pairs that do not fit them, again without those
        pair = usable & ~correlated
        for i in range(m):
            near = np.flatnonzero(pair[i])
            j, k = np.meshgrid(near, near, indexing="ij")
            fit = (j < k) & pair[j, k]
            est = cov[i, j[fit]] * cov[i, k[fit]] / (cov[j[fit], k[fit]] * var)
            # Too few triplets: a mined voter fires on the rare class only.
            sep[i] = math.sqrt(np.median(est)) if len(est) >= 3 else mean[i] / prior
        sep = np.clip(sep, 0.0, 0.999)
        excess = (cov - np.outer(sep, sep) * var) / spread
        np.fill_diagonal(excess, 0.0)
        # A class of several kinds (languages, say) lifts a whole block of voters alike; a pair is
        # correlated when it stands out from the block that its voters are in.
        usual = np.array([np.median(x) if len(x := r[r > 0.1]) >= 3 else 0.0 for r in excess])
        limit = np.maximum(0.25, 1.8 * usual)
        correlated = excess > np.maximum(limit[:, None], limit[None])
    floor = 1 / (n + 2)
    rate0 = np.clip(mean - prior * sep, floor, 0.5)
    rate1 = np.clip(rate0 + sep, 2 * floor, 0.999)
    rate0 = np.minimum(rate0, rate1)
    some = fired / max(n, 1.0)
    some1 = min(0.98, some / prior)
    silent = (min(1 - floor, max(1 - (some - prior * some1) / (1 - prior), floor)), 1 - some1)
    return LabelModel(prior, rate1, rate0, correlated, silent)


def without_copies(labelled: DataFrame) -> DataFrame:
    """One (text, toxic) of each group of rows with the same smallest hash of five words.

    Copies, near ones too, share it nearly always; they would lend weight to a text's chance words.
    For mining only: a text that is left out for a shared passage is still learned from and scored."""

    def keyed(batches):
        for b in batches:
            keys = []
            for t in common.as_bytes(b.column(0)):
                w = common.alnum_words(t)
                keys.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["text", "toxic", "k"])

    rows = labelled.select("text", "toxic").mapInArrow(keyed, "text string, toxic long, k long")
    return rows.groupBy("k").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("r.text", "r.toxic")


def mine(labelled: DataFrame, most: int = FEATURES, min_docs: int = MIN_DOCS) -> list[tuple[bytes, float]]:
    """(feature, z) of (text, toxic), by the surplus of toxic documents among a feature's own.

    Document frequencies are counted by task first, so that a shuffle carries a feature once a task."""

    def counted(batches):
        seen: dict[bytes, list[int]] = {}

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["word", "p", "n"])
            seen.clear()
            return rows

        for b in batches:
            for t, y in zip(common.as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                for w in features(t):
                    x = seen.setdefault(w, [0, 0])
                    x[0] += y
                    x[1] += 1
                if len(seen) > 300_000:
                    yield out()
        yield out()

    totals = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, n = float(totals[0] or 0), float(totals[1])
    if not pos or pos == n:
        return []
    by_word = labelled.select("text", "toxic").mapInArrow(counted, "word binary, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p1, p0 = (F.col("p") + 0.1) / (pos + 1), (F.col("n") - F.col("p") + 0.5) / (n - pos + 1)
    z = (F.col("p") - F.col("n") * (pos / n)) / F.sqrt(F.col("n") * (pos / n) * (1 - pos / n))
    # Copies of a toxic document repeat its chance words: a feature needs a share of the toxic ones.
    lean = by_word.filter(F.col("p") >= max(min_docs, math.ceil(MIN_SHARE * pos))).select("word", F.log(p1 / p0).alias("lean"), z.alias("z")).filter((F.col("lean") > 2.5) & (F.col("z") > 5.0))
    return [(bytes(r[0]), float(r[1])) for r in lean.orderBy(F.desc("z"), "word").limit(most).select("word", "z").collect()]


def _bar(n_docs: int) -> float:
    """A surplus that chance hardly gives to any feature of so many documents, each of which brings
    some 1,500 features."""
    return 1.2 * math.sqrt(2 * math.log(1500 * max(n_docs, 2)))


def lexicon_of(mined: list[tuple[bytes, float]], n_docs: int, size: int = LEXICON) -> list[bytes]:
    """The strongest features, without those that repeat a chosen beginning or are its own beginning."""
    bar = _bar(n_docs)
    out: list[bytes] = []
    for w, z in mined:
        stem = w.rstrip(b"*+")
        if z >= bar and not any(stem.startswith(x.rstrip(b"*+")) and b"*" in x or x.rstrip(b"*+").startswith(stem) for x in out):
            out.append(w)
        if len(out) == size:
            break
    return out


def moments(docs: DataFrame, lexicon: list[bytes]) -> tuple[float, float, np.ndarray]:
    """Number of texts, of texts with a vote, and the voters' joint sums, over all of ``docs`` (text)."""
    m = Voters(lexicon).size

    def run(batches):
        voters, n, fired = Voters(lexicon), 0, 0
        second = np.zeros((m, m), np.int64)
        for b in batches:
            n += b.num_rows
            for t in common.as_bytes(b.column(0)):
                if v := voters.vote(t):
                    fired += 1
                    second[np.ix_(v, v)] += 1
        i, j = np.nonzero(second)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -1, *i.tolist()], pa.int32()), pa.array([-1, -2, *j.tolist()], pa.int32()), pa.array([n, fired, *second[i, j].tolist()], pa.int64())], names=["i", "j", "n"])

    n, fired, second = 0.0, 0.0, np.zeros((m, m))
    for i, j, c in docs.select("text").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if j == -1:
            n = float(c)
        elif j == -2:
            fired = float(c)
        else:
            second[i, j] = c
    return n, fired, second


class Linear:
    """A sparse logistic model over the presence of words and beginnings."""

    def __init__(self, bias: float, weights: dict[bytes, float]) -> None:
        self.bias, self.features, self.weights = bias, FeatureSet(list(weights)), list(weights.values())

    def score(self, text: bytes | None) -> float:
        s = self.bias + sum(self.weights[i] for i in self.features.find(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def train(names: list[bytes], rows: list[tuple[list[int], float]], l1: float = 1e-3, refit: float = 1e-5, steps: int = 300) -> Linear:
    """Logistic regression on (feature numbers, posterior): an L1 fit selects features, and a fit with
    hardly any pull, on those alone, sets their weights."""
    if not rows:
        return Linear(-2.0, {})
    y = np.array([q for _, q in rows])
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feat = np.array([i for f, _ in rows for i in f], np.int64)
    share = min(max(float(y.mean()), 1e-3), 0.5)
    cost = np.where(y > 0.5, min(10.0, 0.5 / share), 1.0)
    cost /= cost.sum()
    w, b = _proximal(doc, feat, y, cost, np.zeros(len(names)), -2.0, l1, steps)
    on = np.abs(w) > 1e-3
    kept = on[feat]
    w, b = _proximal(doc[kept], feat[kept], y, cost, np.where(on, w, 0.0), b, refit, steps)
    return Linear(b, {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)})


def _proximal(doc, feat, y, cost, w, b: float, l1: float, steps: int) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum on mean weighted log loss + l1 |w|, from (w, b)."""
    per = np.bincount(doc, minlength=len(y)) + 1
    rate = 4 / max(float((cost * per).sum()), 1e-9)  # the inverse of the loss's curvature bound
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = vb + np.bincount(doc, v[feat], len(y))
        r = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        moved = v - rate * np.bincount(feat, r[doc], len(w))
        w2 = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
        b2 = vb - rate * float(r.sum())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Linear, LabelModel | None, list[bytes]]:
    """Learn from documents that are not held out; ``labels`` (doc_id, toxic) is read for those only.

    Null ids, null texts and null marks teach nothing; of several marks of a document the highest counts."""
    mod, out = HELD_OUT
    common.prepare(docs.sparkSession)
    seen = docs.select("doc_id", "text").filter(_crc() % mod != out)
    marks = labels.select(F.col("doc_id").alias("__pl_id"), "toxic").filter(F.col("toxic").isNotNull() & (_crc("__pl_id") % mod != out))
    # At most LABELLED_DOCS rows, so they go to the texts and not the texts to them.
    marks = common.hash_sample(marks.groupBy("__pl_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic")), LABELLED_DOCS)
    # A bounded number of texts: dealt to as many files as they ask for, not one a split of the corpus.
    files = -(-LABELLED_DOCS // FILE_DOCS)
    labelled = common.materialize(seen.join(F.broadcast(marks), F.col("doc_id") == F.col("__pl_id")).select("text", "toxic").repartition(files), "labelled")
    distinct = common.materialize(without_copies(labelled).coalesce(files), "mined")
    mined = mine(distinct)
    lexicon = lexicon_of(mined, distinct.count())
    if not lexicon:
        return Linear(-2.0, {}), None, []
    counts = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    model = solve(*moments(seen, lexicon), counts[0] / counts[1])
    names = [w for w, _ in mined]

    def sample_rows(batches):
        voters, found = Voters(lexicon), FeatureSet(names)
        for b in batches:
            texts = common.as_bytes(b.column(0))
            q = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.log_odds(voters.vote(t)))))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([found.find(t) for t in texts], pa.list_(pa.int32())), pa.array(q, pa.float64())], names=["f", "q"])

    sample = common.hash_sample(seen, SAMPLE_DOCS).select("text").mapInArrow(sample_rows, "f array<int>, q double")
    rows = sorted((list(r[0]), r[1]) for r in sample.collect())
    return train(names, rows), model, lexicon


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the score of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in common.as_bytes(b.column(1))], pa.float64())], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of op 4."""
    mod, out = HELD_OUT
    model, _, _ = fit(docs, labels)
    return score(docs, model).select("doc_id", (_crc() % mod == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
