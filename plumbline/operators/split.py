"""Leakage-free document splits: cap, index, reports, weights, and greedy assignment."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax

SPLITS = ("train", "val", "test")
ASSIGNED = ("train", "val")
VAL_BONUS, TRAIN_BONUS = 0.5, 0.1
MAX_BROADCAST_CAP = 100_000


def doc_histogram(index: DataFrame) -> DataFrame:
    """(doc, label, n) of real crops."""
    return index.filter("source = 'real'").groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n"))


def cap_round_robin(index: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Real train rows that stay when no class may exceed ``cap``: a class's documents give one crop a
    round, in a seeded order, until the cap; a cap of 0 or less keeps all."""
    real = index.filter("source = 'real' AND split = 'train'")
    if cap <= 0:
        return real
    key = F.sha1(F.concat_ws(":", F.lit(str(seed)), "label", "path"))
    depth = F.row_number().over(Window.partitionBy("label", "doc").orderBy(key, "path"))
    # Every document's depth beyond the cap is out, whatever the others hold.
    shallow = real.withColumn("depth", depth).filter(F.col("depth") <= cap)
    # A rank is what the rounds before gave plus the place in its own round, so that no window holds
    # more than a row a document; the rounds' offsets are at most classes x cap rows.
    rounds = shallow.groupBy("label", "depth").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("label").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rounds.select("label", "depth", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")).filter(F.col("__o") < cap)
    place = F.row_number().over(Window.partitionBy("label", "depth").orderBy("doc"))
    ranked = shallow.join(F.broadcast(offsets) if cap <= MAX_BROADCAST_CAP else offsets, ["label", "depth"]).withColumn("rank", (F.col("__o") + place).cast("int"))
    return ranked.filter(F.col("rank") <= cap).drop("__o")


def index_rows(index: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """The written index: capped real train, real val, held-out test, then synthetic (train only, no doc)."""
    cols = ["path", "label", "split", "source", "doc"]
    train = cap_round_robin(index, cap, seed).select(*cols)
    rest = index.filter("source = 'real' AND split <> 'train'").select(*cols)
    synth = index.filter("source = 'synth'").withColumn("split", F.lit("train")).withColumn("doc", F.lit(None).cast("string")).select(*cols)
    return train.unionByName(rest).unionByName(synth)


def leakage(assigned: DataFrame, test: DataFrame) -> DataFrame:
    """Documents on both sides."""
    return assigned.select("doc").intersect(test.select("doc"))


def counts_pivot(rows: DataFrame) -> DataFrame:
    """Images by label and split with synthetic ones apart, on the spine, and a TOTAL row."""
    column = F.when(F.col("source") == "synth", "synth").otherwise(F.col("split"))
    wide = rows.groupBy("label").pivot("split", [*SPLITS, "synth"]).agg(F.sum("n")) if "n" in rows.columns else rows.withColumn("split", column).groupBy("label").pivot("split", [*SPLITS, "synth"]).count()
    spine = tax.dimension(rows.sparkSession).select("label")
    by = spine.join(F.broadcast(wide), "label", "left").fillna(0)
    total = by.agg(F.lit("TOTAL").alias("label"), *[F.sum(c).alias(c) for c in (*SPLITS, "synth")])
    return by.unionByName(total).withColumn("train_synth", F.col("train") + F.col("synth"))


def docs_listed(index: DataFrame) -> DataFrame:
    """(split, n_docs, docs): document names of a split, sorted and joined."""
    docs = index.filter("source = 'real'").select("split", "doc").distinct()
    return docs.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(F.sort_array(F.collect_list("doc")), ", ").alias("docs"))


def gap_warnings(rows: DataFrame) -> DataFrame:
    """(label, warning): classes without real or synthetic images, or absent from val or test; with
    documents of a split index (doc, source, split), also the documents that leak, as a row without a
    label."""
    c = counts_pivot(rows).filter("label <> 'TOTAL'")
    none = F.col("train") + F.col("val") + F.col("test") == 0
    absent = [F.when(~none & (F.col(s) == 0), F.lit(f"absent from {s}")) for s in ("val", "test")]
    found = F.array_compact(F.array(F.when(none, F.lit("no real images")), *absent, F.when(F.col("synth") == 0, F.lit("no synthetic images"))))
    out = c.select("label", F.explode(found).alias("warning"))
    if not {"doc", "source", "split"} <= set(rows.columns):
        return out
    real = rows.filter("source = 'real' AND doc IS NOT NULL")
    leaks = leakage(real.filter("split <> 'test'"), real.filter("split = 'test'")).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return out.unionByName(leaks.select(F.lit(None).cast("string").alias("label"), F.concat(F.col("n").cast("string"), F.lit(" documents in train or val and in test")).alias("warning")))


def class_weights(rows: DataFrame) -> DataFrame:
    """Inverse-frequency weights; absent classes count as one image, also in the total."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spine = tax.dimension(rows.sparkSession).join(F.broadcast(n), "label", "left").select("label", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # thirteen rows
    return spine.select("label", "n", F.round(total / (tax.K * F.col("n")), 6).alias("weight"))


def label_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("label").alias("classes"), F.lit(tax.K).alias("of"))


def assign_docs(index: DataFrame, ratios=(0.8, 0.2), existing: dict[str, str] | None = None, seed: int = 0, reassign: bool = False) -> dict[str, str]:
    """Append-stable greedy assignment of documents to train or val.

    Crops are reduced to a row a document in Spark; the greedy choice is sequential over documents by
    definition and runs on the driver."""
    rows = doc_histogram(index).groupBy("doc").agg(F.sum("n").alias("n"), F.collect_set("label").alias("labels")).collect()
    size, labels = {r["doc"]: r["n"] for r in rows}, {r["doc"]: set(r["labels"]) for r in rows}
    want = dict(zip(ASSIGNED, (r * sum(size.values()) for r in ratios), strict=True))
    placed = {} if reassign else {d: s for d, s in (existing or {}).items() if d in size and s in ASSIGNED}
    held = {s: sum(size[d] for d, t in placed.items() if t == s) for s in ASSIGNED}
    seen = {s: set().union(*(labels[d] for d, t in placed.items() if t == s)) for s in ASSIGNED}
    rng = random.Random(seed)
    for d in sorted(size.keys() - placed.keys(), key=lambda d: (-size[d], d)):
        turn = list(ASSIGNED)
        rng.shuffle(turn)  # every document draws, also where nothing ties

        def merit(s, d=d):
            missing = len(labels[d] - seen[s]) / tax.K
            return (want[s] - held[s]) / max(want[s], 1.0) + (VAL_BONUS if s == "val" else TRAIN_BONUS) * missing

        placed[d] = best = max(turn, key=merit)
        held[best] += size[d]
        seen[best] |= labels[d]
    if len(placed) > 1 and "val" not in placed.values():
        placed[min((d for d in placed), key=lambda d: size[d])] = "val"
    return placed


def assigned_frame(index: DataFrame, **options) -> DataFrame:
    spark = index.sparkSession
    return spark.createDataFrame(sorted(assign_docs(index, **options).items()), "doc string, split string")


def best_checkpoint(history: DataFrame, tolerance: float = 1e-6, patience: int = 5) -> DataFrame:
    """(best_epoch, last_epoch): fold over epochs; better is a higher macro F1, or within the tolerance a
    lower validation loss; stops after ``patience`` epochs without a gain."""
    rows = F.sort_array(F.collect_list(F.struct("epoch", F.coalesce(F.nanvl("val_macro_f1", F.lit(-1.0)), F.lit(-1.0)).alias("f1"), "val_loss")))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(-1.0).alias("f1"), F.lit(float("inf")).alias("loss"), F.lit(0).cast("long").alias("last"), F.lit(0).alias("idle"))

    def step(a, x):
        gain = (x["f1"] > a["f1"] + tolerance) | ((F.abs(x["f1"] - a["f1"]) <= tolerance) & (x["val_loss"] < a["loss"]))
        new = F.struct(
            F.when(gain, x["epoch"].cast("long")).otherwise(a["best"]).alias("best"), F.when(gain, x["f1"]).otherwise(a["f1"]).alias("f1"),
            F.when(gain, x["val_loss"]).otherwise(a["loss"]).alias("loss"), x["epoch"].cast("long").alias("last"), F.when(gain, F.lit(0)).otherwise(a["idle"] + 1).alias("idle"),
        )
        return F.when(a["idle"] >= patience, a).otherwise(new)

    return history.groupBy("run").agg(F.aggregate(rows, start, step).alias("r")).select("run", F.col("r.best").alias("best_epoch"), F.col("r.last").alias("last_epoch"))
