"""Scoring and head training: pluggable scorers, preprocessing, softmax regression, epoch loop."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax
from plumbline.operators import pixels

#: Channel means and deviations of the model card.
MEAN = (0.485, 0.456, 0.406)
STD = (0.47853944, 0.4732864, 0.47434163)


#: Training augmentation: largest relative change of brightness, contrast and saturation, and degrees.
JITTER, TURN = (0.15, 0.15, 0.10), 2.0


def augment(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Light colour jitter and a small turn; nothing that could make one chart type another."""
    bright, contrast, sat = (1 + rng.uniform(-j, j) for j in JITTER)
    out = np.clip(img[..., :3].astype(np.float32) * bright, 0, 255)
    out = np.clip((out - out.mean()) * contrast + out.mean(), 0, 255)
    grey = pixels.grey(out)
    out = np.clip((out - grey) * sat + grey, 0, 255)
    return pixels.warp(out, pixels.rotation(rng.uniform(-TURN, TURN), *out.shape[:2]), 0.0)


def preprocess(img: np.ndarray, side: int = 224, rng: np.random.Generator | None = None) -> np.ndarray:
    """(3, side, side) normalised channels of an RGB picture, resized by interpolation; with ``rng``
    augmented for training."""
    small = pixels.resize(img[..., :3], side, side)
    if rng is not None:
        small = augment(small, rng)
    return ((small / 255 - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1)


def predict(rows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], column: str = "embedding", key: str = "id") -> DataFrame:
    """(key, probs) by a batch scorer on an array column; the scorer is shipped once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            p = scorer(flat.reshape(b.num_rows, -1).astype(np.float64)) if b.num_rows else np.empty((0, 1))
            offsets = pa.array(np.arange(b.num_rows + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(p.ravel(), pa.float64()))], names=[key, "probs"])

    return rows.select(key, column).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, probs array<double>")


class SoftmaxHead:
    """A linear softmax; picklable scorer."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def class_weight_map(rows: DataFrame) -> dict[int, float]:
    n = {r[0]: r[1] for r in rows.groupBy("target").count().collect()}
    floor = [max(n.get(i, 0), 1) for i in range(tax.K)]
    return {i: sum(floor) / (tax.K * c) for i, c in enumerate(floor)}


def train_head(rows: DataFrame, epochs: int = 12, rate: float = 0.8, dim: int = 64) -> tuple[SoftmaxHead, list[dict]]:
    """Full-batch gradient steps on (embedding, target): executors sum gradients, the driver moves the
    weights; class-weighted loss; one history row an epoch."""
    weights = class_weight_map(rows)
    cost = np.array([weights[i] for i in range(tax.K)])
    w, b, history = np.zeros((dim, tax.K)), np.zeros(tax.K), []
    for epoch in range(1, epochs + 1):
        head = SoftmaxHead(w, b)

        def run(batches, head=head):
            g, gb, loss, mass, hits, n = np.zeros((dim, tax.K)), np.zeros(tax.K), 0.0, 0.0, 0, 0
            for x in batches:
                e = x.column(0).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1).astype(np.float64)
                y = x.column(1).to_numpy(zero_copy_only=False).astype(int)
                p = head(e)
                c = cost[y]
                loss += float((-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * c).sum())
                mass, hits, n = mass + float(c.sum()), hits + int((p.argmax(1) == y).sum()), n + len(y)
                p[np.arange(len(y)), y] -= 1
                p *= c[:, None]
                g, gb = g + e.T @ p, gb + p.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([gb.tobytes()], pa.binary()), pa.array([loss]), pa.array([mass]), pa.array([hits], pa.int64()), pa.array([n], pa.int64())], names=["g", "gb", "loss", "mass", "hits", "n"])

        parts = rows.select("embedding", "target").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "g binary, gb binary, loss double, mass double, hits long, n long").collect()
        mass, n = sum(r["mass"] for r in parts), sum(r["n"] for r in parts)
        if not n:
            break
        w = w - rate / mass * sum(np.frombuffer(r["g"]).reshape(dim, tax.K) for r in parts)
        b = b - rate / mass * sum(np.frombuffer(r["gb"]) for r in parts)
        history.append({"epoch": epoch, "train_loss": round(sum(r["loss"] for r in parts) / mass, 6), "train_acc": round(sum(r["hits"] for r in parts) / n, 6)})
    return SoftmaxHead(w, b), history


class Network(SoftmaxHead):
    """A linear backbone under a softmax head; picklable scorer."""

    def __init__(self, backbone: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        super().__init__(weights, bias)
        self.backbone = backbone

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return super().__call__(x @ self.backbone)

    def groups(self, backbone_rate: float, head_rate: float, frozen: bool) -> list[tuple[str, float]]:
        """(parameter, rate): a low rate for the backbone, none while it is frozen, a higher for the head."""
        return [("backbone", 0.0 if frozen else backbone_rate), ("weights", head_rate), ("bias", head_rate)]


def _arrays(column, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64) if rows else np.empty((0, 1))


def _few(rows: DataFrame) -> DataFrame:
    return rows.select("embedding", "target").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def evaluate(rows: DataFrame, model: SoftmaxHead) -> dict:
    """loss (mean, unweighted), acc and macro_f1 over classes with support, of (embedding, target);
    NaN without rows.  Tasks sum losses and a confusion matrix."""

    def run(batches):
        cm, loss = np.zeros((tax.K, tax.K)), 0.0
        for x in batches:
            y = x.column(1).to_numpy(zero_copy_only=False).astype(int)
            p = model(_arrays(x.column(0), x.num_rows)) if len(y) else np.empty((0, tax.K))
            loss += float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
            np.add.at(cm, (y, p.argmax(1)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([cm.tobytes()], pa.binary()), pa.array([loss])], names=["cm", "loss"])

    parts = _few(rows).mapInArrow(run, "cm binary, loss double").collect()
    cm = sum((np.frombuffer(r["cm"]).reshape(tax.K, tax.K) for r in parts), np.zeros((tax.K, tax.K)))
    n, hit, nan = cm.sum(), np.diag(cm), float("nan")
    if not n:
        return {"loss": nan, "acc": nan, "macro_f1": nan}
    f1 = 2 * hit / np.maximum(cm.sum(0) + cm.sum(1), 1)
    return {"loss": float(sum(r["loss"] for r in parts) / n), "acc": float(hit.sum() / n), "macro_f1": float(f1[cm.sum(1) > 0].mean())}


def fine_tune(rows: DataFrame, val: DataFrame | None = None, epochs: int = 12, head_rate: float = 0.8, backbone_rate: float = 0.05, freeze_epochs: int = 1, patience: int = 5, dim: int = 64, start: Network | None = None) -> tuple[Network, list[dict]]:
    """The best network on (embedding, target), and a history row an epoch.

    Full-batch steps of a class-weighted loss: executors sum gradients, the driver moves the
    parameters.  The backbone starts as the identity (or where ``start`` left it) and does not move in
    the first ``freeze_epochs``.  After each epoch the validation rows are scored; the best epoch has the
    highest macro F1 (within 1e-6: the lower loss), without validation rows the last; ``patience`` epochs
    without a better one end the training, 0 never."""
    cost = np.array([w for _, w in sorted(class_weight_map(rows).items())])
    model = start or Network(np.eye(dim), np.zeros((dim, tax.K)), np.zeros(tax.K))
    best, top, since, history = model, (-1.0, float("inf")), 0, []
    for epoch in range(1, epochs + 1):

        def run(batches, net=model):
            sums = {"backbone": np.zeros((dim, dim)), "weights": np.zeros((dim, tax.K)), "bias": np.zeros(tax.K)}
            loss = mass = 0.0
            for x in batches:
                if not x.num_rows:
                    continue
                e, y = _arrays(x.column(0), x.num_rows), x.column(1).to_numpy(zero_copy_only=False).astype(int)
                p, c = net(e), cost[y]
                loss, mass = loss + float((-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * c).sum()), mass + float(c.sum())
                p[np.arange(len(y)), y] -= 1
                p *= c[:, None]
                sums["weights"] += (e @ net.backbone).T @ p
                sums["bias"] += p.sum(0)
                sums["backbone"] += e.T @ (p @ net.weights.T)
            yield pa.RecordBatch.from_arrays([*(pa.array([g.tobytes()], pa.binary()) for g in sums.values()), pa.array([loss]), pa.array([mass])], names=[*sums, "loss", "mass"])

        parts = _few(rows).mapInArrow(run, "backbone binary, weights binary, bias binary, loss double, mass double").collect()
        mass = sum(r["mass"] for r in parts)
        if not mass:
            break
        moved = {}
        for name, rate in model.groups(backbone_rate, head_rate, epoch <= freeze_epochs):
            old = getattr(model, name)
            moved[name] = old - rate / mass * sum(np.frombuffer(r[name]).reshape(old.shape) for r in parts)
        model = Network(**moved)
        seen = evaluate(val, model) if val is not None else dict.fromkeys(("loss", "acc", "macro_f1"), float("nan"))
        history.append({"epoch": epoch, "train_loss": round(float(sum(r["loss"] for r in parts) / mass), 6), **{f"val_{k}": round(v, 6) for k, v in seen.items()}})
        macro, loss = seen["macro_f1"], seen["loss"]
        if macro != macro or macro > top[0] + 1e-6 or abs(macro - top[0]) <= 1e-6 and loss < top[1]:
            best, since = model, 0
            top = top if macro != macro else (macro, loss)
        else:
            since += 1
            if patience and since >= patience:
                break
    return best, history


def check_labels(checkpoint: list[str]) -> None:
    """A checkpoint's label order must be the taxonomy's."""
    if list(checkpoint) != list(tax.LABELS):
        gone, new = [x for x in tax.LABELS if x not in checkpoint], [x for x in checkpoint if x not in tax.LABELS]
        raise ValueError(f"label order differs from the taxonomy; missing {gone}, unknown {new}")


def score_replies(images: DataFrame, call: Callable[[str], tuple[str | None, float | None, str | None]], retries: int = 2, concurrency: int = 5, pause: float = 0.5) -> DataFrame:
    """Judge calls by a pluggable client ``call(file) -> (reply, cost, error)``; at most ``concurrency`` of
    a task are under way at once.  A failed call is tried ``retries`` times more, after ``pause``
    seconds, then twice that, and so on; cost adds up, the last answer counts, and a client that raises
    has failed."""

    def one(file: str) -> tuple:
        cost, spent = 0.0, False
        for attempt in range(1 + retries):
            if attempt:
                time.sleep(pause * attempt)
            try:
                reply, c, error = call(file)
            except Exception as e:
                reply, c, error = None, None, f"{type(e).__name__}: {e}"
            spent, cost = spent or c is not None, cost + (c or 0.0)
            if error is None:
                break
        return reply, cost if spent else None, error, attempt + 1

    def run(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                found = list(pool.map(one, b["file"]))
                out = b[["file", "call_idx"]].copy()
                for k, name in enumerate(("content", "cost", "error", "attempts")):
                    out[name] = pd.Series([f[k] for f in found], index=out.index, dtype="float64" if name == "cost" else "int64" if name == "attempts" else object)
                yield out

    return images.select("file", F.col("call_idx").cast("long")).mapInPandas(run, "file string, call_idx long, content string, cost double, error string, attempts long")


def save_head(spark, head: SoftmaxHead, path: str) -> None:
    """A checkpoint as one JSON file, with its label order."""
    import json

    from plumbline.sources import sinks

    sinks.write_text(spark, path, json.dumps({"labels": list(tax.LABELS), "weights": head.weights.tolist(), "bias": head.bias.tolist()}))


def load_head(spark, path: str) -> SoftmaxHead:
    """A saved head; another label order raises."""
    import json

    spec = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    check_labels(spec["labels"])
    return SoftmaxHead(np.array(spec["weights"]), np.array(spec["bias"]))
