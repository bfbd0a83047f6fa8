"""Benchmark metrics of a scored split: (id, probs, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax

FLOOR = 1e-12


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def scored(probs: DataFrame) -> DataFrame:
    """Adds pred (the first maximum), p_pred and p_true."""
    top = F.array_max("probs")
    return probs.withColumns({"p_pred": top, "pred": (F.array_position("probs", top) - 1).cast("int"), "p_true": F.try_element_at("probs", (F.col("target") + 1).cast("int"))})


def nll_accuracy(probs: DataFrame) -> DataFrame:
    s = scored(probs)
    return s.agg(F.round(-F.avg(F.log(F.greatest("p_true", F.lit(FLOOR)))), 6).alias("nll"), F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def matrix(probs: DataFrame) -> DataFrame:
    return scored(probs).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))


def normalized(counts: DataFrame) -> DataFrame:
    """Row shares; a row sum counts as one at least."""
    return counts.withColumn("share", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("target")), F.lit(1)), 6))


def prf(counts: DataFrame, classes: int = tax.K) -> DataFrame:
    """(cls, precision, recall, f1, support, predicted) of every class of a (target, pred, n) matrix."""
    sides = counts.select(F.explode(F.array(F.struct(F.col("target").alias("cls"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    by = sides.groupBy("cls").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    spine = counts.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    c = spine.join(F.broadcast(by), "cls", "left").fillna(0)  # a row a class
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("cls", F.round(div(F.col("tp"), F.col("predicted")), 6).alias("precision"), F.round(div(F.col("tp"), F.col("support")), 6).alias("recall"), F.round(div(2 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"), "support", "predicted")


def macro_f1_present(counts: DataFrame, classes: int = tax.K) -> DataFrame:
    """Mean F1 over classes with support only."""
    return prf(counts, classes).filter("support > 0").agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def active(counts: DataFrame, classes: int = tax.K) -> DataFrame:
    """Classes that occur as target or prediction."""
    return prf(counts, classes).filter("support > 0 OR predicted > 0")


def merge_map(groups: list[list[str]], labels=tax.LABELS) -> tuple[list[str], dict[int, int]]:
    """Merged names and the old-to-new numbers; unknown or repeated names raise."""
    flat = [x for g in groups for x in g]
    if unknown := set(flat) - set(labels):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    if len(flat) != len(set(flat)):
        raise ValueError("a class is merged twice")
    head = {g[0]: g for g in groups}
    inner = {x for g in groups for x in g[1:]}
    names = ["+".join(head[x]) if x in head else x for x in labels if x not in inner]
    first = {x: g[0] for g in groups for x in g}
    order = [x for x in labels if x not in inner]
    return names, {i: order.index(first.get(x, x)) for i, x in enumerate(labels)}


def _number(c: Column, ids: dict[int, int]) -> Column:
    return F.element_at(F.array(*[F.lit(ids[i]) for i in range(len(ids))]), (c + 1).cast("int"))


def merged(probs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """One row of metrics with classes merged: the matrix collapses, probabilities add up."""
    names, ids = merge_map(groups)
    m = scored(probs).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n")).select(_number(F.col("target"), ids).alias("target"), _number(F.col("pred"), ids).alias("pred"), "n").groupBy("target", "pred").agg(F.sum("n").alias("n"))
    acc = m.agg(F.round(F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    own = F.aggregate(F.array(*[F.struct(F.lit(new).alias("k"), F.element_at("probs", old + 1).alias("p")) for old, new in ids.items()]), F.lit(0.0), lambda a, x: a + F.when(x["k"] == _number(F.col("target"), ids), x["p"]).otherwise(0.0))
    nll = probs.agg(F.round(-F.avg(F.log(F.greatest(own, F.lit(FLOOR)))), 6).alias("nll"))
    return macro_f1_present(m, len(names)).join(F.broadcast(acc)).join(F.broadcast(nll))  # single rows


def confusion_pairs(probs: DataFrame, target: int, pred: int, most: int = 16) -> DataFrame:
    """The most confident mistakes of one kind first."""
    return scored(probs).filter((F.col("target") == target) & (F.col("pred") == pred)).select("id", F.round("p_pred", 6).alias("p_pred")).orderBy(F.desc("p_pred"), "id").limit(most)


def remap(targets: DataFrame, checkpoint: list[str]) -> DataFrame:
    """(id, model_id): targets by the checkpoint's own label order; missing labels raise on collection."""
    if missing := set(tax.LABELS) - set(checkpoint):
        labels = targets.select("label").distinct().filter(F.col("label").isin(*missing))
        if not labels.isEmpty():
            raise ValueError(f"labels missing from the checkpoint: {sorted(r[0] for r in labels.collect())}")
    at = targets.sparkSession.createDataFrame(list(enumerate(checkpoint)), "model_id int, label string")
    return targets.join(F.broadcast(at), "label")


def missing_labels(targets: DataFrame, checkpoint: list[str]) -> DataFrame:
    at = targets.sparkSession.createDataFrame([(x,) for x in checkpoint], "label string")
    return targets.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(at), "label", "left_anti")


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Mean loss of an epoch, by batch sizes."""
    return batches.groupBy("epoch").agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 6).alias("loss"))
