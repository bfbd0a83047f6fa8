"""Writers: guarded, partitioned, atomic."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax


#: Folder names of a manifest's writes.
APPEND = "append-"


class SplitError(ValueError):
    """Synthetic data may go to the training split only."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put ``new`` in the place of ``path``: what was there is renamed first and removed last, so that
    a crash at any point leaves a whole copy beside it (``.old``) or in its place."""
    (src, fs), (dst, _) = _fs(spark, new), _fs(spark, path)
    old = None
    if fs.exists(dst):
        old, _ = _fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
        if not fs.rename(dst, old):
            raise OSError(f"cannot rename {path}")
    try:
        done = fs.rename(src, dst)
    except Exception:
        done = False
    if not done:
        if old is not None:
            fs.rename(old, dst)
        raise OSError(f"cannot rename {new} to {path}")
    if old is not None:
        fs.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_manifest(rows: DataFrame, path: str, append: bool = False) -> str | None:
    """JSON lines; an old manifest is moved to a stamped backup before it is replaced.

    Every write is a folder of its own by number, so that later records are read as later ones."""
    spark, backup = rows.sparkSession, None
    p, fs = _fs(spark, path)
    if not append and fs.exists(p):
        backup = f"{path.rstrip('/')}.{time.strftime('%Y%m%d_%H%M%S')}.bak"
        number = 1
        while exists(spark, backup):  # two writes in a second
            number += 1
            backup = f"{path.rstrip('/')}.{time.strftime('%Y%m%d_%H%M%S')}_{number}.bak"
        if not fs.rename(p, _fs(spark, backup)[0]):
            raise OSError(f"cannot rename {path}")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    last = max((int(n[len(APPEND) :]) for n in names if n.startswith(APPEND) and n[len(APPEND) :].isdigit()), default=0)
    rows.write.json(f"{path.rstrip('/')}/{APPEND}{last + 1:06d}")
    return backup


def rewrite_lines(lines: DataFrame, path: str) -> None:
    """Replace a manifest by its patched lines, in order: written beside it, then renamed."""
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    lines.orderBy("ord").select("value").write.text(new)
    replace(lines.sparkSession, new, path)


def write_routed(rows: DataFrame, path: str) -> None:
    """Kept crops by destination, junk by reason kind."""
    kind = F.regexp_replace(F.regexp_replace("reason", r"_\d.*$", ""), "[^a-z_]", "")
    rows.filter("reason IS NULL").write.mode("append").partitionBy("routed_to").parquet(f"{path}/review")
    rows.filter("reason IS NOT NULL").withColumn("kind", kind).write.mode("append").partitionBy("kind").parquet(f"{path}/junk")


def write_samples(rows: DataFrame, path: str, split: str = "train", append: bool = True) -> None:
    """Synthetic samples by label; any split but train is refused, and so is an unknown label."""
    if split != "train":
        raise SplitError(f"synthetic samples belong to train, not to {split}")
    checked = rows.filter(F.col("error").isNull()).withColumn("label", F.when(tax.known(F.col("label")), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col("label")))))
    checked.withColumn("split", F.lit(split)).write.mode("append" if append else "overwrite").partitionBy("label").parquet(path)


def write_index(rows: DataFrame, path: str) -> None:
    """The split index as JSON lines, partitioned so that a split or source prunes folders."""
    rows.select("path", "label", "doc", "split", "source").write.mode("overwrite").partitionBy("split", "source").json(path)


def write_assignments(rows: DataFrame, path: str) -> None:
    """(doc, split) as one JSON object; one row a document."""
    write_text(rows.sparkSession, path, json.dumps(dict(sorted((r[0], r[1]) for r in rows.select("doc", "split").collect())), ensure_ascii=False, indent=1))


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def dump_failures(rows: DataFrame, path: str) -> None:
    """A dump a failed call, in a folder by its stem: the call, its error and the raw reply (``content``,
    where that is a column)."""
    raw = F.col("content") if "content" in rows.columns else F.lit(None).cast("string")
    body = F.concat_ws("\n", F.concat(F.lit("file:     "), "file"), F.concat(F.lit("call_idx: "), F.col("call_idx").cast("string")), F.concat(F.lit("error:    "), F.coalesce("error", F.lit(""))), F.lit("-" * 60), F.coalesce(raw, F.lit("(no reply)")))
    rows.select("stem", body.alias("value")).write.mode("append").partitionBy("stem").text(path)


def write_plots(runs: DataFrame, path: str, only: list[str] | None = None) -> list[str]:
    """The figures of a judged run as SVG files; returns their names."""
    from plumbline.operators import plots

    drawn = plots.draw_all(runs, only)
    for name, svg in drawn.items():
        write_text(runs.sparkSession, f"{path}/{name}.svg", svg)
    return list(drawn)


def write_history(spark: SparkSession, history: list[dict], path: str) -> None:
    """history.csv and loss_curve.svg of a training."""
    from plumbline.operators import plots

    cols = ["epoch", "train_loss", "val_loss", "val_acc", "val_macro_f1"]
    write_text(spark, f"{path}/history.csv", "\n".join([",".join(cols), *(",".join(str(h[c]) for c in cols) for h in history)]) + "\n")
    write_text(spark, f"{path}/loss_curve.svg", plots.loss_curve(history))


def write_benchmark_plot(counts: DataFrame, path: str, split: str, labels=tax.LABELS) -> None:
    """The confusion figure of a benchmark's (target, pred, n)."""
    from plumbline.operators import bench, plots

    write_text(counts.sparkSession, path, plots.benchmark_confusion([r.asDict() for r in bench.normalized(counts).collect()], split, list(labels)))


def write_stats(made: DataFrame, path: str, real: DataFrame | None = None, name: str = "manifest") -> str:
    """stats.md of a synthetic manifest."""
    from plumbline.operators import qa

    text = qa.stats_report(made, real, name)
    write_text(made.sparkSession, path, text)
    return text


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def jsonable(x):
    """NaN and infinities become null, at any depth."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [jsonable(v) for v in x]
    return x


def write_report(blocks: dict[str, DataFrame], warnings: DataFrame, path: str, title: str = "Report") -> dict:
    """metrics.json and report.md of named result frames, each of a few rows, but for per-file rows,
    which go to CSV."""
    spark = warnings.sparkSession
    out, lines = {}, [f"# {title}", ""]
    warned = [r.asDict() for r in warnings.collect()]
    lines += [f"- {w['warning']}: {w['n']}" for w in warned] + [""] * bool(warned)
    for name, df in blocks.items():
        if name == "per_file":
            write_csv(df, f"{path}/per_file.csv")
            continue
        rows = [r.asDict(recursive=True) for r in df.collect()]
        out[name] = jsonable(rows)
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in df.columns) + " |" for r in rows] + [""]
    write_text(spark, f"{path}/metrics.json", json.dumps({"warnings": warned, "blocks": out}, ensure_ascii=False, indent=1))
    write_text(spark, f"{path}/report.md", "\n".join(lines))
    return out


def write_meta(spark: SparkSession, path: str, config: dict, results: dict | None = None) -> None:
    """Run metadata, written at the start and again with results at the end."""
    write_text(spark, path, json.dumps(jsonable({"config": config, "results": results, "finished": results is not None}), ensure_ascii=False, indent=1))


def collect_labeled(images: DataFrame, path: str) -> DataFrame:
    """Confirmed images (label, path) by class folder; returns counts with shares, largest first."""
    from plumbline.operators import route

    kept = images.filter(tax.known(F.col("label")))
    kept.write.mode("overwrite").partitionBy("label").parquet(path)
    return route.shares(kept.select("label"), "label").orderBy(F.desc("n"), "label")
