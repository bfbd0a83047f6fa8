"""Extraction routing: junk reasons, label mapping, layered decisions, ids, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text

#: Thresholds of the junk filter, and the reasons it gives.
MIN_SIDE, MIN_AREA, MAX_ASPECT, MIN_RANGE = 120, 30_000, 8.0, 12
TOO_SMALL, SMALL_AREA, EXTREME_ASPECT, UNIFORM = "too_small_%dx%d", "area_too_small_%d", "extreme_aspect_%.1f", "near_uniform"
THRESHOLD = 0.75

#: Raw classifier labels and the classes they map to; labels that always go to review.
RAW_TO_CLASS = {
    "bar_chart": "bar", "line_chart": "line", "pie_chart": "pie_donut", "geographical_map": "map", "topographical_map": "map",
    "table": "table", "photograph": "photo", "logo": "other", "icon": "other", "stamp": "other", "signature": "other",
    "flow_chart": "flow", "scatter_plot": "scatter", "box_plot": "other", "engineering_drawing": "other",
    "chemistry_structure": "other", "screenshot_from_computer": "other", "screenshot_from_manual": "other",
    "page_thumbnail": "other", "full_page_image": "other", "music": "other", "calendar": "other", "qr_code": "other",
    "bar_code": "other", "crossword_puzzle": "other", "other": "other",
}
ALWAYS_REVIEW = ("other", "full_page_image", "page_thumbnail", "screenshot_from_computer")


def junk_reason(w: Column, h: Column, lo: Column, hi: Column, min_side=MIN_SIDE, min_area=MIN_AREA, max_aspect=MAX_ASPECT) -> Column:
    """The first reason to discard a crop, or null."""
    aspect = F.greatest(w / h, h / w)
    return (
        F.when((w < min_side) | (h < min_side), F.format_string(TOO_SMALL, w, h))
        .when(w * h < min_area, F.format_string(SMALL_AREA, w * h))
        .when(aspect > max_aspect, F.format_string(EXTREME_ASPECT, aspect))
        .when(hi - lo < MIN_RANGE, F.lit(UNIFORM))
    )


def size_ok(w: Column, h: Column) -> Column:
    return (w >= MIN_SIDE) & (h >= MIN_SIDE) & (w * h >= MIN_AREA) & (F.greatest(w / h, h / w) <= MAX_ASPECT)


def mapped(raw: Column) -> Column:
    """Class of a raw label; unknown ones are ``other``."""
    pairs = [F.lit(x) for kv in RAW_TO_CLASS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), F.lit("other"))


def decide(crops: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds mapped_label, routed_to and decision_layer: tables, then the classifier, then the model's
    answer where it is strictly above the threshold."""
    table = F.col("kind") == "table"
    own = F.when(table, F.lit("table")).otherwise(mapped(F.col("raw_label")))
    review = (F.col("raw_confidence") < threshold) | F.col("raw_label").isin(*ALWAYS_REVIEW)
    llm = ~table & (F.col("llm_confidence") > threshold)
    return crops.withColumns({
        "mapped_label": own,
        "routed_to": F.when(table, F.lit("table")).when(llm, F.col("llm_label")).when(review, F.lit("_review")).otherwise(own),
        "decision_layer": F.when(table, F.lit("docling")).when(llm, F.lit("llm")).when(review, F.lit("manual")).otherwise(F.lit("docling")),
    })


def crop_ids(crops: DataFrame, order: str) -> DataFrame:
    """Adds crop_id (stem, page, running number in reading order) and the output name."""
    number = F.row_number().over(Window.partitionBy("source_pdf").orderBy(order))
    crop = F.format_string("%s__p%03d__%03d", text.stem(F.col("source_pdf")), F.coalesce(F.col("page"), F.lit(0)), number)
    out = crops.withColumn("crop_id", crop)
    return out.withColumn("filename", F.format_string("%s__%s__%.2f.png", F.col("crop_id"), mapped(F.col("raw_label")), F.col("raw_confidence")))


def bbox_clip(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Bottom-left box to a clipped top-left one; null when nothing is left."""
    l, r = F.greatest(F.least(x0, x1), F.lit(0.0)), F.least(F.greatest(x0, x1), width)
    t, b = F.greatest(F.least(height - y0, height - y1), F.lit(0.0)), F.least(F.greatest(height - y0, height - y1), height)
    return F.when((r > l) & (b > t), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def totals(routed: DataFrame) -> DataFrame:
    """Kept, junk and reviewed crops, and the model's cost over kept ones."""
    kept = F.col("reason").isNull()
    return routed.agg(
        F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_junk"),
        F.count_if(kept & (F.col("routed_to") == "_review")).alias("n_review"),
        F.round(F.sum(F.when(kept, F.col("llm_cost"))), 4).alias("llm_cost"),
    )


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts with shares of the total, and a TOTAL row from the same pass."""
    by = rows.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("g"))
    total = F.max(F.when(F.col("g") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))  # one row a label
    return by.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(column)).alias(column), "n", F.round(100 * F.col("n") / total, 4).alias("share"))


def validate_reply(replies: DataFrame) -> DataFrame:
    """label, confidence and error of model replies: JSON recovered from prose, then checked."""
    v = text.json_object(F.col("content"))
    kind = F.schema_of_variant(F.try_variant_get(F.col("v"), "$.confidence", "variant"))
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    c = F.try_variant_get(F.col("v"), "$.confidence", "double")
    label = F.when(F.schema_of_variant(F.try_variant_get(F.col("v"), "$.label", "variant")) == "STRING", F.try_variant_get(F.col("v"), "$.label", "string"))
    good = label.isNotNull() & (F.trim(label) != "") & number & ~F.isnan(c) & c.between(0, 1)
    good = F.coalesce(good, F.lit(False))
    out = replies.withColumn("v", v)
    error = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit("no message in LLM response")).when(F.col("v").isNull(), F.lit("invalid JSON in LLM response")).when(~good, F.lit("response did not match the expected schema"))
    return out.withColumns({"label": F.when(good, label), "confidence": F.when(good, c), "error": error}).drop("v")
