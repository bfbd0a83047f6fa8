"""File-tree scans.  Only metadata is read: the content column is pruned."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as tax
from plumbline.functions import text
from plumbline.sources import sinks

REVIEW_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
JUDGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp")
DATASET_EXTENSIONS = (".png", ".jpg", ".jpeg")
PHOTO_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp")


def _files(spark: SparkSession, root: str) -> DataFrame:
    # Listings skip names with a leading underscore, so the review folders are named.
    roots = [root, *[f"{root}/{x}" for x in tax.REVIEW_FOLDERS if sinks.exists(spark, f"{root}/{x}")]]
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # A missing folder is an empty one.
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")


def scan(spark: SparkSession, root: str, extensions=DATASET_EXTENSIONS) -> DataFrame:
    """(path, folder, name, length) below ``root``, by extension in either case."""
    f = _files(spark, root).filter(text.suffix(F.col("path")).isin(*extensions))
    parts = F.split("path", "/")
    return f.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length")


def documents(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Source documents in path order, the first ``limit`` of them if given."""
    d = scan(spark, root, (".pdf",)).orderBy("path")
    return d.limit(limit) if limit else d


def review_tree(spark: SparkSession, root: str) -> DataFrame:
    """(doc, label, path): images in class folders only."""
    return scan(spark, root).filter(tax.known(F.col("folder"))).select(text.doc_of(F.col("name")).alias("doc"), F.col("folder").alias("label"), "path")


def synth_tree(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root).filter(tax.known(F.col("folder"))).select(F.col("folder").alias("label"), "path")


def judge_set(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Images by class, and the classes without any."""
    images = scan(spark, root, JUDGE_EXTENSIONS).filter(tax.known(F.col("folder"))).select(F.col("folder").alias("true"), "path", F.concat_ws("/", "folder", "name").alias("file"))
    empty = tax.dimension(spark).select(F.col("label").alias("true")).join(images.select("true").distinct(), "true", "left_anti")
    return images, empty


def folder_counts(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, REVIEW_EXTENSIONS).groupBy("folder").agg(F.count(F.lit(1)).alias("images")).orderBy(F.lower("folder"))


def listing(spark: SparkSession, root: str, folder: str) -> DataFrame:
    return scan(spark, root, REVIEW_EXTENSIONS).filter(F.col("folder") == folder).select("name", "length").orderBy(F.lower("name"))


def photos(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, PHOTO_EXTENSIONS).select("path", text.report_stem(F.col("name")).alias("report")).orderBy("path")


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, data_url) with content, for scorers that take base64."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", text.data_url(F.col("path"), F.col("content")).alias("data_url"))
