"""Evaluation of repeated judge calls.

The frame is one row a call: file, true, pred, confidence, call_idx, cost, error, ok.  Two reduced
forms serve every block: per-file votes and (true, pred) counts; both are map-side combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax

BOOTSTRAP_REPS = 2000
ALPHA = 0.05
SMOOTH = 0.5
CLIP = 1e-12
BINS = 10


def tidy(raw: DataFrame) -> DataFrame:
    """Typed frame from raw records; ``ok`` is taken on the raw strings, then unknown labels become null."""
    true = F.coalesce(F.when(F.col("true") != "", F.col("true")), F.element_at(F.split("file", "/"), 1))
    ok = F.col("pred").isNotNull() & (F.col("pred") == F.col("true"))
    out = raw.withColumn("true", true).withColumn("ok", ok).withColumn("call_idx", F.coalesce("call_idx", F.lit(0)))
    for c in ("true", "pred"):
        out = out.withColumn(c, F.when(tax.known(F.col(c)), F.col(c)))
    return out.select("file", "true", "pred", "confidence", F.col("call_idx").cast("long"), "cost", "error", "ok")


def votes(runs: DataFrame) -> DataFrame:
    """(file, true, pred, n, first_idx): calls of a file by predicted label, failures as ``__none__``."""
    return runs.groupBy("file", F.coalesce("pred", F.lit(tax.NONE)).alias("pred")).agg(F.count(F.lit(1)).alias("n"), F.min("call_idx").alias("first_idx"))


def overall(runs: DataFrame) -> DataFrame:
    """One row: counts, micro and macro accuracy, failures and cost."""
    by_class = runs.filter(F.col("true").isNotNull()).groupBy("true").agg(F.avg(F.col("ok").cast("double")).alias("acc"))
    macro = by_class.agg(F.avg("acc").alias("macro_accuracy"), F.count(F.lit(1)).alias("n_classes"))
    n, failed = F.count(F.lit(1)), F.count_if(F.col("pred").isNull())
    one = runs.agg(
        n.alias("n_calls"), F.count_distinct("file").alias("n_images"), F.avg(F.col("ok").cast("double")).alias("micro_accuracy"),
        failed.alias("n_failed"), F.try_divide(failed, n).alias("failed_rate"), F.sum("cost").alias("cost_total"), F.avg("cost").alias("cost_mean"),
    )
    both = one.join(F.broadcast(macro))  # two single rows
    r = lambda c, d: F.round(c, d).alias(c)
    return both.select("n_calls", "n_images", F.round(F.try_divide("n_calls", "n_images"), 2).alias("calls_per_image"), "n_classes", r("micro_accuracy", 6), r("macro_accuracy", 6), "n_failed", r("failed_rate", 4), r("cost_total", 4), r("cost_mean", 6))


def dense_index(files: DataFrame, key: str = "file") -> DataFrame:
    """``idx`` 0..n-1 in the order of (md5 prefix, key), without a global sort: rows are numbered inside
    4096 hash buckets and the buckets' offsets are added."""
    part = files.withColumn("__b", F.substring(F.md5(F.col(key).cast("binary")), 1, 3))
    sizes = part.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return part.withColumn("__i", inside).join(F.broadcast(offsets), "__b").withColumn("idx", F.col("__o") + F.col("__i")).drop("__b", "__i", "__o")


def draw_index(rep: Column, draw: Column, n: Column) -> Column:
    """A quadratic hash of (rep, draw) modulo a prime, the same in every SQL engine.

    The squares matter: under an affine map the draws of a replicate would be evenly spaced.  Each step
    is a lambda, whose argument is computed once: as a plain expression it would be written out twice
    a step."""
    h = F.array((rep * 1000003 + draw * 7919 + 12345) % 2147483647)
    for _ in range(3):
        h = F.transform(h, lambda x: (x * x + x * 48271 + 11) % 2147483647)
    return F.coalesce(F.element_at(h, 1) % n, F.lit(0).cast("long"))


def bootstrap(runs: DataFrame, macro: bool = False, reps: int = BOOTSTRAP_REPS, alpha: float = ALPHA) -> DataFrame:
    """(lo, hi, reps): percentile interval of accuracy over files resampled with replacement.

    Files are first reduced to sufficient statistics, one row a file (and label); draws are rows made
    on the executors, joined to the statistics by number and summed by replicate, at any size: the
    statistics are broadcast where they are small, and draws are combined in the tasks before the
    shuffle."""
    stats = runs.groupBy("file", "true").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("k"))
    files = dense_index(runs.select("file").distinct())
    n = files.count()
    spark = runs.sparkSession
    if n:
        rep = F.floor(F.col("id") / n)
        draws = spark.range(reps * n).select(rep.alias("rep"), draw_index(rep, F.col("id") % n, F.lit(n)).alias("idx"))
    else:
        draws = spark.range(0).select(F.col("id").alias("rep"), F.col("id").alias("idx"))
    numbered = stats.join(files, "file").select("idx", "true", "n", "k")
    if not macro:
        numbered = numbered.groupBy("idx").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    picked = draws.join(numbered.filter(F.col("true").isNotNull()) if macro else numbered, "idx")
    share = (F.sum("k") / F.sum("n")).alias("a")
    stat = picked.groupBy("rep", "true").agg(share).groupBy("rep").agg(F.avg("a").alias("a")) if macro else picked.groupBy("rep").agg(share)
    return stat.agg(F.round(F.percentile("a", F.lit(alpha / 2)), 6).alias("lo"), F.round(F.percentile("a", F.lit(1 - alpha / 2)), 6).alias("hi"), F.count(F.lit(1)).alias("reps"))


def confusion_counts(runs: DataFrame) -> DataFrame:
    """(true, pred, n) over labelled, answered calls."""
    return runs.filter(F.col("true").isNotNull() & F.col("pred").isNotNull()).groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_normalized(runs: DataFrame) -> DataFrame:
    """Counts as shares of their true label's answered calls."""
    n = confusion_counts(runs)
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true")), 6))


def confusion_pivot(runs: DataFrame) -> DataFrame:
    """One row a true label, a column a predicted label; the spine keeps unobserved labels."""
    wide = confusion_counts(runs).groupBy("true").pivot("pred", list(tax.LABELS)).sum("n")
    spine = tax.dimension(runs.sparkSession).select(F.col("label").alias("true"))
    return spine.join(wide, "true", "left").fillna(0, list(tax.LABELS))


def prf(runs: DataFrame) -> DataFrame:
    """(label, tp, predicted, support) on the label spine; failed calls count in the support."""
    t = runs.filter(F.col("true").isNotNull()).groupBy(F.col("true").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("pred") == F.col("true")).alias("tp"), F.count_distinct("file").alias("images"), F.avg("confidence").alias("mean_conf"))
    p = runs.filter(F.col("pred").isNotNull()).groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    spine = tax.dimension(runs.sparkSession).select("label")
    out = spine.join(F.broadcast(t), "label", "left").join(F.broadcast(p), "label", "left")  # at most 13 rows each
    return out.fillna(0, ["support", "tp", "images", "predicted"])


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of (tp, predicted, support); zero where undefined."""
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def per_class(runs: DataFrame) -> DataFrame:
    c = scores(prf(runs))
    return c.select("label", "images", F.col("support").alias("calls"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "mean_conf")])


def macro_weighted_f1(runs: DataFrame) -> DataFrame:
    """Macro F1 over all thirteen labels, and support-weighted F1."""
    c = scores(prf(runs))
    return c.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias("weighted_f1"))


def per_file(runs: DataFrame) -> DataFrame:
    """One row a file: votes, modal label (ties: first seen), agreement, entropy, accuracy, confidence."""
    v = votes(runs)
    total = F.sum("n").over(Window.partitionBy("file"))
    p = F.col("n") / total
    parts = v.withColumns({"__t": total, "__h": -(p * F.log2(p))})
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("first_idx").alias("b"), F.col("pred").alias("c"), "n")))
    by_votes = parts.groupBy("file").agg(
        F.array_join(F.transform(listed, lambda x: F.concat(x["c"], F.lit("x"), x["n"].cast("string"))), ", ").alias("votes"),
        F.element_at(listed, 1)["c"].alias("modal_pred"), (F.max("n") / F.first("__t")).alias("agreement"), F.count(F.lit(1)).alias("distinct_labels"), F.sum("__h").alias("entropy_bits"),
    )
    by_calls = runs.groupBy("file").agg(F.min_by("true", "call_idx").alias("true"), F.count(F.lit(1)).alias("n_calls"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_conf"), F.stddev_pop("confidence").alias("conf_std"))
    return by_calls.join(by_votes, "file")


PER_FILE_COLUMNS = ("agreement", "entropy_bits", "accuracy", "mean_conf", "conf_std")


def per_file_table(runs: DataFrame) -> DataFrame:
    t = per_file(runs)
    t = t.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in PER_FILE_COLUMNS})
    return t.withColumn("entropy_bits", F.abs("entropy_bits")).orderBy("accuracy", F.desc("entropy_bits"), "file")


def buckets(runs: DataFrame) -> DataFrame:
    t = per_file(runs)
    return t.agg(F.count_if(F.col("accuracy") == 0).alias("n_always_wrong"), F.count_if(F.col("accuracy") == 1).alias("n_always_right"), F.count_if(F.col("distinct_labels") > 1).alias("n_flippy"))


def consistency(runs: DataFrame, by_class: bool = False) -> DataFrame:
    t = per_file(runs)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    flip = F.round(F.avg((F.col("distinct_labels") > 1).cast("double")), 6).alias("flip_rate")
    if by_class:
        return t.filter(F.col("true").isNotNull()).groupBy("true").agg(mean("agreement", "agreement"), flip, F.round(F.abs(F.avg("entropy_bits")), 6).alias("mean_entropy"))
    return t.agg(mean("agreement", "agreement_mean"), flip, F.round(F.abs(F.avg("entropy_bits")), 6).alias("mean_entropy_bits"), mean("conf_std", "mean_conf_std"))


def usable(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("pred").isNotNull() & F.col("confidence").isNotNull())


def reliability(runs: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins, (lo, hi] but for the first, on a spine that keeps empty bins."""
    bin_of = F.greatest(F.ceil(F.col("confidence") * bins).cast("int") - 1, F.lit(0))
    agg = usable(runs).filter(F.col("confidence").between(0, 1)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_conf"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
    spine = runs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(F.broadcast(agg), "bin", "left").fillna(0, ["n"])  # one row a bin
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_conf")))


def reliability_table(runs: DataFrame, bins: int = BINS) -> DataFrame:
    t = reliability(runs, bins)
    return t.select("bin", F.round(F.col("bin") / bins, 6).alias("bin_lo"), F.round((F.col("bin") + 1) / bins, 6).alias("bin_hi"), "n", *[F.round(c, 6).alias(c) for c in ("mean_conf", "accuracy", "gap")])


def ece_mce(runs: DataFrame, bins: int = BINS) -> DataFrame:
    t = reliability(runs, bins)
    return t.agg(F.round(F.try_divide(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))), F.sum("n")), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


def losses(runs: DataFrame) -> DataFrame:
    """Confidence log loss in closed form, Brier, mean confidences, and the smoothed-vote log loss."""
    k = tax.K
    c = F.col("confidence")
    clip = lambda x: F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP))
    own, rest = clip(c), clip((1 - c) / (k - 1))
    p = F.when(F.col("ok"), own).otherwise(rest) / (own + (k - 1) * rest)
    ok = F.col("ok").cast("double")
    calls = usable(runs).agg(F.avg(-F.log(p)).alias("confidence_logloss"), F.avg(F.pow(c - ok, F.lit(2))).alias("brier_top_label"))
    means = runs.agg(F.avg(F.when(F.col("ok"), c)).alias("mean_conf_correct"), F.avg(F.when(~F.col("ok"), c)).alias("mean_conf_wrong"))
    first = runs.groupBy("file").agg(F.min_by("true", "call_idx").alias("t"), F.count("pred").alias("answered"))
    hits = runs.filter(F.col("pred").isNotNull()).groupBy("file", "pred").agg(F.count(F.lit(1)).alias("n"))
    voted = first.filter(F.col("t").isNotNull()).join(hits.withColumnRenamed("pred", "t"), ["file", "t"], "left")
    emp = voted.agg(F.avg(-F.log((F.coalesce("n", F.lit(0)) + SMOOTH) / (F.col("answered") + SMOOTH * k))).alias("empirical_logloss"))
    names = ("confidence_logloss", "empirical_logloss", "brier_top_label", "mean_conf_correct", "mean_conf_wrong")
    both = calls.join(F.broadcast(means)).join(F.broadcast(emp))  # single rows
    return both.select(*[F.round(n, 6).alias(n) for n in names])


def validate(raw: DataFrame) -> DataFrame:
    """(warning, n): unknown true labels (on the raw strings), failed calls, uneven repeats."""
    true = F.coalesce(F.when(F.col("true") != "", F.col("true")), F.element_at(F.split("file", "/"), 1))
    unknown = raw.filter(~tax.known(true)).agg(F.count_distinct(true).alias("n")).select(F.lit("true labels outside taxonomy").alias("warning"), "n")
    failed = raw.filter(F.col("pred").isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("failed calls").alias("warning"), "n")
    repeats = raw.groupBy("file").agg(F.count_distinct("call_idx").alias("r")).agg(F.count_distinct("r").alias("n")).filter("n > 1").select(F.lit("uneven repeat counts").alias("warning"), "n")
    return unknown.unionByName(failed).unionByName(repeats).filter("n > 0")


def worst_classes(runs: DataFrame) -> DataFrame:
    """``per_class``, the lowest recall first (ties by label)."""
    return per_class(runs).orderBy("recall", "label")


def prf_long(runs: DataFrame) -> DataFrame:
    """(label, metric, value): the melted frame behind the grouped bars."""
    return per_class(runs).unpivot(["label"], ["precision", "recall", "f1"], "metric", "value")


def confidence_histogram(runs: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of confidences by equal-width bin and correctness; the last bin is closed."""
    at = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    return runs.filter(F.col("confidence").isNotNull()).groupBy(at.alias("bin"), "ok").agg(F.count(F.lit(1)).alias("n"))


def agreement_histogram(runs: DataFrame, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.round(F.col("agreement") * bins, 9)).cast("int"), F.lit(bins - 1))
    return per_file(runs).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def failures(runs: DataFrame) -> DataFrame:
    """(stem, file, call_idx, error) of failed calls; the stem names the dump."""
    stem = F.concat(F.regexp_replace(F.regexp_replace("file", r"\.[^./]+$", ""), "/", "__"), F.lit("__c"), F.col("call_idx").cast("string"))
    return runs.filter(F.col("pred").isNull()).select(stem.alias("stem"), "file", "call_idx", "error")


def call_plan(images: DataFrame, repeats: int) -> DataFrame:
    """Every image with every repeat number."""
    return images.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("call_idx"))


def retry_fold(attempts: DataFrame) -> DataFrame:
    """One row a call: cost summed over its attempts, last answer kept."""
    return attempts.groupBy("call").agg(F.round(F.sum("cost"), 6).alias("cost"), F.max_by("pred", "attempt").alias("pred"), F.count(F.lit(1)).alias("attempts"))


def run_totals(runs: DataFrame, every: int = 25) -> DataFrame:
    """Totals of a finished run, and how many progress lines it printed."""
    return runs.agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("pred").isNull()).alias("n_failed"), F.round(F.sum("cost"), 4).alias("cost_total"), F.floor(F.count(F.lit(1)) / every).alias("progress_lines"))


BLOCKS = {"overall": overall, "per_class": per_class, "per_file": per_file_table, "consistency": consistency, "calibration": losses}
PLOT_FRAMES = {"confusion": confusion_normalized, "reliability": reliability_table, "class_accuracy": per_class, "class_prf": prf_long, "confidence": confidence_histogram, "agreement": agreement_histogram}


def report(raw: DataFrame, blocks=None) -> dict[str, DataFrame]:
    """The named metric blocks over one tidy frame; unknown names are skipped."""
    runs = tidy(raw)
    return {name: BLOCKS[name](runs) for name in (blocks or BLOCKS) if name in BLOCKS}
