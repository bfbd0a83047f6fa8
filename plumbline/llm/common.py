"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_made: list[tuple[SparkSession, str]] = []


#: Rows of an Arrow batch where the session leaves it open: texts may be long.
BATCH_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even when only the driver's path has it, and keep
    Arrow batches of whole texts small unless the session says otherwise."""
    if spark.conf.get(_ROWS_KEY, None) is None:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, _REPO) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or the session's own checkpoint folder.

    Where neither is set, a local master gets a folder of this machine; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables written so far (of ``spark``): for long sessions, once the lazy
    results that read them are used up.  What is left goes when the driver's process ends."""
    for own, path in list(_made):
        if spark is None or own is spark:
            _made.remove((own, path))
            try:
                own.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
                _delete(own, path)
            except Exception:  # the JVM may be gone already; the cluster's own cleaning remains
                return


atexit.register(clear)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def table_name(path: str) -> str:
    """The name in the session's catalog of a table written to a new path."""
    return "plumbline_" + path.rpartition("/")[2].replace("-", "_")


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    _made.remove((spark, path))
    spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
    _delete(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a lost executor
    costs a re-read and not the work above."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``materialize``, and the path for ``drop``."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes objects, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: ASCII tables: A-Z lowered, and every byte that is not a word byte made a space.
LOWER = bytes(range(256)).lower()
ALNUM_WORDS = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in LOWER)


def token_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z."""
    return [] if not text else text.lower().split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and any non-ASCII character, A-Z lowered."""
    return [] if not text else text.translate(ALNUM_WORDS).split()


def byte_groups(texts: list[bytes | None], most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Slices of the texts of about ``most`` bytes, a longer text alone or at a slice's end."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def hash_sample(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest row hashes: the same on every run and cluster.

    All of ``df`` where it has no more.  Else rows that are alike in every column are one row, so
    repeated ids and texts neither fill the sample nor empty it.  Only hashes below a bound are
    sorted; the bound is raised until enough distinct ones are below it."""
    n = df.count()
    if n <= most:
        return df
    cols = df.columns
    hashed = df.withColumn("__pl_h", F.xxhash64(F.lit("sample"), *[F.col(c) for c in cols]))
    place, share = F.pmod("__pl_h", F.lit(1 << 40)), 2 * most / n
    while True:
        low = hashed.filter(place < int(min(share, 1.0) * (1 << 40)))
        found = low.groupBy("__pl_h").agg(F.count(F.lit(1)).alias("n")).select(place.alias("place"), "__pl_h").orderBy("place", "__pl_h").limit(most)
        last = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("place", "__pl_h")).alias("top")).first()
        if share >= 1 or last["n"] == most:
            break
        share *= 8
    low = low.filter(F.struct(place.alias("place"), F.col("__pl_h").alias("h")) <= F.struct(F.lit(last["top"][0]), F.lit(last["top"][1])))
    return low.groupBy("__pl_h").agg(F.first(F.struct(*cols)).alias("__pl_r")).select("__pl_r.*")
