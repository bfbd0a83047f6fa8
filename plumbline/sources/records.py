"""Record files: judge runs, manifests, split indexes, class-count plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax
from plumbline.operators import judge, manifest
from plumbline.sources import sinks

RUN = "file string, true string, pred string, confidence double, call_idx long, cost double, error string"
INDEX = "path string, label string, split string, source string, doc string"
CROP = (
    "crop_id string, source_pdf string, language string, page long, kind string, width long, height long, bbox array<double>, raw_label string, raw_confidence double, "
    "mapped_label string, llm_label string, llm_confidence double, llm_cost double, routed_to string, decision_layer string, filename string, manual_root string"
)


def read_runs(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Judge calls; a malformed line fails the read, blank lines are skipped."""
    df = spark.read.schema(RUN).option("mode", "FAILFAST").json(path)
    return df if raw else judge.tidy(df)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of a file, or of all writes to a manifest's folder, with an ordinal that
    follows the writes, then files by name, then the place in the file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    append = F.regexp_extract("_metadata.file_path", rf"/{sinks.APPEND}(\d+)/", 1).try_cast("int")
    place = F.struct(F.coalesce(append, F.lit(0)).alias("append"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(place.alias("ord"), "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records by filename, the last wins; blank, malformed and nameless lines are skipped."""
    lines = read_lines(spark, path).withColumn("r", F.from_json("value", CROP + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return manifest.last_wins(lines.filter("r IS NOT NULL AND r._bad IS NULL").select("ord", "r.*").drop("_bad"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records for statistics: a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def union_manifests(real: DataFrame, made: DataFrame) -> DataFrame:
    """Records of an extraction and of a generator together; what one side lacks is null there."""
    return real.unionByName(made, allowMissingColumns=True)


def read_index(spark: SparkSession, path: str, split: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, label_id) of a split, and the unknown labels that were skipped."""
    rows = spark.read.schema(INDEX).json(path).filter(F.col("split") == split)
    rows = rows.filter(F.col("source") == source) if source else rows
    known = rows.filter(tax.known(F.col("label"))).select("path", tax.id_of(F.col("label")).alias("label_id"))
    return known, rows.filter(~tax.known(F.col("label"))).groupBy("label").count()


def read_assignments(spark: SparkSession, path: str) -> dict[str, str]:
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return {str(k): str(v) for k, v in json.loads(text or "{}").items()}


def load_class_counts(path: str) -> dict[str, int]:
    """A validated plan ``label: count`` from a small YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        plan = yaml.safe_load(f)
    if plan is None:
        raise ValueError(f"{path}: empty")
    if not isinstance(plan, dict):
        raise ValueError(f"{path}: expected a mapping of class to count")
    if unknown := sorted(set(map(str, plan)) - set(tax.LABELS)):
        raise ValueError(f"{path}: unknown classes {unknown}")
    for k, v in plan.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise ValueError(f"{path}: {k}: {v!r} is no count")
    if not any(plan.values()):
        raise ValueError(f"{path}: nothing to make")
    return dict(plan)


def plan_gaps(plan: dict[str, int]) -> tuple[list[str], list[str]]:
    """(omitted classes, classes set to zero)."""
    return [x for x in tax.LABELS if x not in plan], [k for k, v in plan.items() if v == 0]


def resolve_run(spark: SparkSession, path: str) -> str:
    """The run file of a run folder, or the path itself when it is a file."""
    for name in (f"{path.rstrip('/')}/run.jsonl", path):
        if sinks.exists(spark, name):
            return name
    raise FileNotFoundError(path)
