"""Regions of documents: one page to many figures and tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import pixels

TAG = r"(?is)<(table|img|figure|svg|ul|ol)\b[^>]*>"


def extract_regions(pages: DataFrame) -> DataFrame:
    """(page_id, number, kind, tag) of html pages, in reading order; pages without regions give no row.

    A stand-in for a layout model: tables (lists count as such) and pictures by their tags."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(TAG), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("number", "tag"))
    name = F.lower(F.regexp_extract("tag", r"(?i)<([a-z]+)", 1))
    return rows.select("page_id", (F.col("number") + 1).alias("number"), F.when(name.isin("table", "ul", "ol"), "table").otherwise("picture").alias("kind"), name.alias("tag"))


def complex_pages(pages: DataFrame) -> DataFrame:
    """(doc, pages): numbers of pages with a figure or table, joined; ``pages``: doc, page, html."""
    found = pages.filter(F.col("html").rlike(TAG))
    return found.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


@dataclass(frozen=True)
class ExtractorConfig:
    """What a layout extractor is built with; page pictures and table structure are not asked of it."""

    model_path: str | None = None
    scale: float = 2.0
    ocr: bool = False
    device: str = "auto"
    threads: int | None = None
    page_images: bool = False
    table_structure: bool = False


REGION = "source_pdf string, page long, kind string, number long, left double, top double, right double, bottom double, page_height double, image binary, error string"
_FIELDS = [f.split()[0] for f in REGION.split(", ")]
_built: dict = {}


def extract_documents(docs: DataFrame, build: Callable[[ExtractorConfig], Callable[[str, bytes], Iterable[dict]]], config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """Regions of (path, content) by a pluggable extractor, one to many; boxes from the page's bottom.

    ``build`` runs once in a worker and configuration.  A document that fails gives one row with its
    error; numbers run by document in the extractor's order unless it gives its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if config not in _built:
            _built[config] = build(config)
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [{"number": k, **r, "source_pdf": path} for k, r in enumerate(_built[config](path, bytes(content)), 1)]
                except Exception as e:
                    rows.append({"source_pdf": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[r.get(f) for f in _FIELDS] for r in rows], columns=_FIELDS)

    return docs.select("path", "content").mapInPandas(run, REGION)


def render_region(page: np.ndarray, box: tuple[float, float, float, float], scale: float) -> np.ndarray | None:
    """The part of a page picture (drawn at ``scale``) under a box (left, top, right, bottom) from the
    page's bottom: corners in any order, clipped to the page; None where nothing is left."""
    h, w = page.shape[:2]
    x0, y0, x1, y1 = box
    left, right = (min(max(v * scale, 0.0), w) for v in sorted((x0, x1)))
    top, bottom = (min(max(h - v * scale, 0.0), h) for v in sorted((y0, y1), reverse=True))
    cut = page[int(top) : math.ceil(bottom), int(left) : math.ceil(right)]
    return cut if right > left and bottom > top and cut.size else None


def table_crops(regions: DataFrame, pages: DataFrame, scale: float = 2.0) -> DataFrame:
    """(source_pdf, page, number, width, height, image) of table regions, cut from page pictures
    (source_pdf, page, image) drawn at ``scale``; pages count from 1; empty boxes and pages without a
    picture give no row."""
    both = regions.filter("kind = 'table'").select("source_pdf", "page", "number", "left", "top", "right", "bottom").join(pages.select("source_pdf", "page", F.col("image").alias("picture")), ["source_pdf", "page"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                cut = render_region(pixels.decode(bytes(r.picture)), (r.left, r.top, r.right, r.bottom), scale)
                if cut is not None:
                    rows.append((r.source_pdf, r.page, r.number, cut.shape[1], cut.shape[0], pixels.png(np.ascontiguousarray(cut))))
            yield pd.DataFrame(rows, columns=["source_pdf", "page", "number", "width", "height", "image"])

    return both.mapInPandas(run, "source_pdf string, page long, number long, width long, height long, image binary")
