"""Manifest index, pairing status, and commits of queued moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text


def last_wins(records: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One record a filename, the last by ``ordinal``; rows without a filename are skipped."""
    cols = [c for c in records.columns if c not in ("filename", ordinal)]
    kept = records.filter(F.col("filename").isNotNull()).groupBy("filename").agg(F.max_by(F.struct(*cols), ordinal).alias("r"))
    return kept.select("filename", "r.*")


#: The record fields that an image listing shows.
SHOWN = ("routed_to", "manual_root", "raw_label", "raw_confidence", "mapped_label", "llm_label", "source_pdf", "page", "width", "height")


def join_images(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Folder images with their records; ``in_manifest`` says whether there is one."""
    return images.join(manifest.withColumn("__hit", F.lit(True)), "filename", "left").withColumn("in_manifest", F.col("__hit").isNotNull()).drop("__hit")


def image_meta(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """(folder, file, meta): the shown fields of each image's record and ``in_manifest``; fields that the
    manifest does not have are null."""
    fields = [F.col(c) if c in manifest.columns else F.lit(None).cast("string").alias(c) for c in SHOWN]
    known = manifest.select("filename", *fields)
    return join_images(images.select("filename", "folder"), known).select("folder", F.col("filename").alias("file"), F.struct(*SHOWN, "in_manifest").alias("meta"))


def pairing_status(folders: DataFrame, images: DataFrame, manifest: DataFrame) -> DataFrame:
    """(folder, status, matched, checked): none, missing, outside, no_match or ok.

    ``folders``: folder, root, manifest_path, manifest_dir, exists."""
    hit = images.join(manifest.select("filename", F.lit(1).alias("__hit")), "filename", "left").groupBy("folder").agg(F.count(F.lit(1)).alias("checked"), F.count("__hit").alias("matched"))
    f = folders.join(hit, "folder", "left").fillna(0, ["checked", "matched"])
    judged = F.col("manifest_path").isNotNull() & F.col("exists") & text.within(F.col("root"), F.col("manifest_dir"))
    status = (
        F.when(F.col("manifest_path").isNull(), "none").when(~F.col("exists"), "missing").when(~text.within(F.col("root"), F.col("manifest_dir")), "outside")
        .when((F.col("checked") > 0) & (F.col("matched") == 0), "no_match").otherwise("ok")
    )
    counted = judged & (F.col("checked") > 0)
    return f.select("folder", status.alias("status"), F.when(counted, F.col("matched")).alias("matched"), F.when(counted, F.col("checked")).otherwise(F.lit(0)).alias("checked"))


def commit_moves(moves: DataFrame, files: DataFrame, root: str = "/data") -> DataFrame:
    """Apply an ordered script of moves: (ord, file, from, to) against (file, folder) below ``root``.

    Every move sees the ones before it.  Paths are joined and normalised first; what does not stay
    below the root is refused.  Moves of one file name are folded in order over the set of folders
    that hold it; names do not touch each other, so the script is parallel by name.  Rows with a
    missing field or from = to do nothing and give no row."""
    top = F.lit(root)
    src, dst = (text.normalized(text.joined(top, F.col(c), F.col("file"))) for c in ("from", "to"))
    below = lambda p: F.regexp_replace(F.substring(p, len(root.rstrip("/")) + 2, F.length(p)), "/?[^/]*$", "")
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    real = moves.filter("file <> '' AND `from` <> '' AND `to` <> '' AND `from` <> `to`").withColumns({"__src": src, "__dst": dst})
    bad = ~(text.within(F.col("__src"), top) & text.within(F.col("__dst"), top))
    step_of = F.struct("ord", F.col("file"), F.col("from").alias("src"), F.col("to").alias("dst"), bad.alias("bad"), below(F.col("__src")).alias("home"), below(F.col("__dst")).alias("goal"))
    script = real.groupBy(name(F.col("__src")).alias("name")).agg(F.sort_array(F.collect_list(step_of)).alias("steps"))
    at = files.groupBy(F.col("file").alias("name")).agg(F.collect_set("folder").alias("folders"))
    both = script.join(at, "name", "left").withColumn("folders", F.coalesce("folders", F.array().cast("array<string>")))
    start = F.struct(F.col("folders").alias("held"), F.array().cast("array<struct<ord:bigint,file:string,src:string,dst:string,reason:string>>").alias("out"))

    def step(a, m):
        reason = (
            F.when(m["bad"], F.lit("path escapes root")).when(~F.array_contains(a["held"], m["home"]), F.lit("source file missing"))
            .when(F.array_contains(a["held"], m["goal"]), F.concat(F.lit("already exists in "), m["dst"]))
        )
        held = F.when(reason.isNull(), F.array_append(F.array_remove(a["held"], m["home"]), m["goal"])).otherwise(a["held"])
        row = F.struct(m["ord"].cast("bigint").alias("ord"), m["file"].alias("file"), m["src"].alias("src"), m["dst"].alias("dst"), reason.alias("reason"))
        return F.struct(held.alias("held"), F.array_append(a["out"], row).alias("out"))

    done = both.select(F.explode(F.aggregate("steps", start, step)["out"]).alias("m"))
    return done.select(F.col("m.ord").alias("ord"), F.col("m.file").alias("file"), F.col("m.src").alias("from"), F.col("m.dst").alias("to"), F.col("m.reason").isNull().alias("moved"), F.col("m.reason").alias("reason"))


def patch_manifest(lines: DataFrame, report: DataFrame) -> DataFrame:
    """Lines (ord, value) with ``manual_root`` set where their file moved; other lines byte for byte.

    An old ``manual_root`` is replaced where it stands; else the key goes before the closing brace."""
    moved = report.filter("moved").groupBy("file").agg(F.max_by("to", "ord").alias("dst"))
    name = F.try_variant_get(F.try_parse_json("value"), "$.filename", "string")
    joined = lines.withColumn("__f", name).join(moved, F.col("__f") == F.col("file"), "left")
    # The folder as a JSON string, escaped by the writer of JSON; then quoted for use as a replacement.
    written = F.to_json(F.struct(F.col("dst").alias("x")))
    quoted = F.concat(F.lit('"manual_root": '), F.substring(written, 6, F.length(written) - 6))
    literal = F.regexp_replace(quoted, r"([\\$])", r"\\$1")
    old = r'(?<!\\)"manual_root"\s*:\s*("(?:[^"\\]|\\.)*"|null)'
    body = F.regexp_replace(F.rtrim("value"), r"\}$", "")
    grown = F.concat(body, F.when(F.rlike(body, F.lit(r"^\s*\{\s*$")), F.lit("")).otherwise(F.lit(", ")), quoted, F.lit("}"))
    has = F.map_contains_key(F.from_json("value", "map<string,string>"), "manual_root")
    changed = F.when(has, F.regexp_replace(F.col("value"), F.lit(old), literal)).otherwise(grown)
    return joined.select("ord", F.when(F.col("dst").isNotNull(), changed).otherwise(F.col("value")).alias("value"), F.col("dst").isNotNull().alias("touched"))


def moved_without_record(report: DataFrame, manifest: DataFrame) -> DataFrame:
    return report.filter("moved").select("file").distinct().join(manifest.select(F.col("filename").alias("file")), "file", "left_anti")


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)))
