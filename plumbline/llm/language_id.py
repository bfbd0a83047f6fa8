"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of fixed length.  In each window, filters of several
widths slide over byte embeddings; the rectified maximum of every filter feeds a softmax over the
learned languages.  A text's probabilities are the mean of its windows', weighted by their bytes:
every byte of every text is read.  Training (Adam, on the driver) takes a bounded sample of labelled
windows, at most ``SAMPLE_WINDOWS``, drawn by hash from all windows of all labelled texts.

For scoring, embedding and filters are multiplied out: a filter's response is a sum of table rows
indexed by byte pairs, so a batch is a few numpy gathers of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
#: Most labelled windows that the network is trained on.
SAMPLE_WINDOWS = 16_000
EPOCHS = 4
HELD_OUT = (4, 2)
UNDETERMINED = "und"
#: The pipeline's stage rejects documents below this probability, and undetermined ones.
LEAST_SCORE = 0.4
_LETTER = regex.compile(r"\p{L}").search
_CHUNK = 512


class ByteCnn:
    """Weights of the network; ``langs`` is in the order of the softmax."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"E": rng.normal(0, 0.3, (256, DIM)).astype(np.float32), "O": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """x: (n, WINDOW) bytes, zero behind the end; y: class numbers."""
        rng, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[at].copy(), y[at]
                short = rng.random(len(xb)) < 0.4  # short texts are common in the field
                keep = np.where(short, rng.integers(12, WINDOW, len(xb)), WINDOW)
                xb[np.arange(WINDOW) >= keep[:, None]] = 0
                g, step = self._gradient(xb, yb), step + 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["E"][x]
        pooled, where = [], []
        for w in WIDTHS:
            flat = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM)
            z = flat @ p[f"W{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            where.append((at, top > 0))
        h = np.concatenate(pooled, 1)
        s = h @ p["O"] + p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["O"], g["c"] = h.T @ s, s.sum(0)
        dh = s @ p["O"].T
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            at, on = where[i]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            g[f"b{w}"] = d.sum(0)
            for j in range(w):
                b = x[rows, at + j]  # the byte under offset j of each filter's best place
                part = slice(j * DIM, (j + 1) * DIM)
                g[f"W{w}"][part] += np.einsum("nfd,nf->df", p["E"][b], d)
                np.add.at(g["E"], b, d[:, :, None] * p[f"W{w}"][part].T[None])
        return g

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
        """Per width: responses by the first byte pair, by the byte or pair behind it, and the width."""
        out = []
        for w in WIDTHS:
            t = [self.p["E"] @ self.p[f"W{w}"][j * DIM : (j + 1) * DIM] for j in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            first = pair(t[0], t[1]) + self.p[f"b{w}"]
            out.append((np.ascontiguousarray(first, np.float32), None if w == 2 else np.ascontiguousarray(t[2] if w == 3 else pair(t[2], t[3]), np.float32), w))
        return out


class Scorer:
    """Probabilities of whole texts by the multiplied-out tables."""

    def __init__(self, net: ByteCnn) -> None:
        self.langs, self.tables, self.out, self.bias = net.langs, net.tables(), net.p["O"], net.p["c"]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(n, classes) probabilities of (n, WINDOW) bytes."""
        probs = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), _CHUNK):
            b = x[at : at + _CHUNK].astype(np.int32)
            pairs = b[:, :-1] << 8 | b[:, 1:]
            pooled = []
            for first, rest, w in self.tables:
                z = first.take(pairs[:, : WINDOW - w + 1], axis=0)
                if w == 3:
                    z += rest.take(b[:, 2:], axis=0)
                elif w == 4:
                    z += rest.take(pairs[:, 2:], axis=0)
                pooled.append(np.maximum(z.max(1), 0))
            s = np.concatenate(pooled, 1) @ self.out + self.bias
            s = np.exp(s - s.max(1, keepdims=True))
            probs[at : at + _CHUNK] = s / s.sum(1, keepdims=True)
        return probs

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """(n, classes) probabilities of whole texts, from all their windows."""
        x, owner, weight = cut_windows(texts)
        out = np.zeros((len(texts), len(self.langs)))
        np.add.at(out, owner, self.windows(x).astype(np.float64) * weight[:, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded) of the texts, the text of each, and its number of bytes."""
    sizes = np.array([max(1, len(t)) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    joined = b"".join([t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, count, strict=True)])
    x = np.frombuffer(joined, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return x, owner, np.minimum(sizes[owner] - place * WINDOW, WINDOW).astype(np.float64)


def labelled_windows(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(lang, piece): windows of the labelled texts that are not held out, cut as for scoring; all of
    them, or with ``most`` about twice as many, by the hash of text and place (more where that gives
    fewer distinct ones)."""
    mod, out = HELD_OUT
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (crc % mod != out))
    count = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    total = known.agg(F.sum(count)).first()[0] or 0 if most else 0
    share = 2 * most / total if most and total else 1.0

    def chosen(share: float) -> DataFrame:
        # Places are chosen before any window is cut: a long text is not copied window by window.
        places = F.sequence(F.lit(0), count - 1)
        if share < 1:
            places = F.filter(places, lambda i: F.pmod(F.xxhash64(F.col("h"), i), F.lit(1 << 40)) < int(share * (1 << 40)))
        rows = known.withColumn("h", F.xxhash64("lang", "text") if share < 1 else F.lit(0)).select("lang", "text", F.explode(places).alias("i"))
        return rows.select("lang", F.substring(F.col("text").cast("binary"), F.col("i") * WINDOW + 1, F.lit(WINDOW)).alias("piece"))

    while share < 1:
        found = chosen(share).persist()  # few rows, which a lost executor makes again
        if found.distinct().count() >= most:
            return found
        found.unpersist()
        share *= 8
    return chosen(1.0)


def fit(docs: DataFrame, most: int = SAMPLE_WINDOWS) -> ByteCnn | None:
    """Train on at most ``most`` windows of labelled texts that are not held out; None without any.

    Inputs are windows of the text alone; ``lang`` is the label only.  A window without a letter
    teaches nothing."""
    common.prepare(docs.sparkSession)
    windows = labelled_windows(docs, most)
    sample = common.hash_sample(windows, most)
    rows = sorted((r[0], bytes(r[1])) for r in sample.collect())
    windows.unpersist()
    rows = [(lang, t) for lang, t in rows if _LETTER(t.decode("utf-8", "ignore"))]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    net = ByteCnn(langs)
    x = np.frombuffer(b"".join([t.ljust(WINDOW, b"\0") for _, t in rows]), np.uint8).reshape(-1, WINDOW)
    net.train(x, np.array([langs.index(r[0]) for r in rows]))
    return net


def _judged(texts: list[bytes | None], scorer: Scorer | None) -> tuple[list[str], list[float]]:
    """Language and score of each text, in groups of a bounded size."""
    pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    real = [i for i, t in enumerate(texts) if t and scorer and _LETTER(t.decode())]
    while real:
        held, n = 0, 0
        while n < len(real) and held < 4 << 20:
            held += len(texts[real[n]])
            n += 1
        part, real = real[:n], real[n:]
        p = scorer.texts([texts[i] for i in part])
        for i, k, v in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            pred[i], score[i] = scorer.langs[k], min(1.0, v)
    return pred, score


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; no letter, null text or no learned language: ``und``, 0."""
    spark = docs.sparkSession
    common.prepare(spark)
    scorer = spark.sparkContext.broadcast(None if net is None else Scorer(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = _judged(common.as_bytes(b.column(1)), scorer.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op 9."""
    mod, out = HELD_OUT
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return predict(docs, fit(docs)).select("doc_id", (crc % mod == out).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or below ``least``; all columns.

    Every row is judged by its own text, where it stands: nothing is shuffled."""
    net = fit(docs)
    scorer = docs.sparkSession.sparkContext.broadcast(None if net is None else Scorer(net))

    @F.arrow_udf(T.BooleanType())
    def known(text: pa.Array) -> pa.Array:
        pred, score = _judged(common.as_bytes(text), scorer.value)
        return pa.array([p != UNDETERMINED and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_())

    return docs.filter(known("text"))
