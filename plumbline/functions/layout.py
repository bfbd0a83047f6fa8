"""Layout arithmetic that needs no font metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_axis(lo: Column, hi: Column, least: float) -> Column:
    """Margins (lo, hi) shrunk in proportion so that ``least`` of the axis stays free."""
    over = lo + hi > 1 - least
    f = (1 - least) / (lo + hi)
    return F.struct(F.when(over, lo * f).otherwise(lo).alias("lo"), F.when(over, hi * f).otherwise(hi).alias("hi"))


def shrink(block: Column, most: Column, factor: float = 0.92, steps: int = 14) -> Column:
    """A block's size after up to ``steps`` reductions until it fits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), block.cast("double"), lambda x, _: F.when(x > most, x * factor).otherwise(x))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled word by word; a longer word has its own line."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(a, w):
        joined = F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
        fits = (a["line"] == "") | (F.length(joined) <= width)
        return F.struct(F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["line"])).alias("done"), F.when(fits, joined).otherwise(w).alias("line"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))


def normalize(values: Column) -> Column:
    """Min-max to [0, 1]."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: (v - lo) / (hi - lo + 1e-9))


def stack_totals(series: Column) -> Column:
    """Column sums of an array of equally long arrays."""
    return F.aggregate(series, F.transform(F.element_at(series, 1), lambda _: F.lit(0.0)), lambda a, s: F.zip_with(a, s, lambda x, y: x + y))


def spread_meta(row: Column, meta: Column) -> Column:
    """String maps merged; the renderer's keys win."""
    kept = F.map_filter(row, lambda k, _: ~F.map_contains_key(meta, k))
    return F.map_concat(kept, meta)


def ranked(names: Column, values: Column, ascending: bool = False) -> Column:
    """(name, value) pairs in the order of their values, the largest first unless ``ascending``; equal
    values keep their places."""
    n = F.size(names)
    keyed = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x, i: F.struct((x["v"] if ascending else -x["v"]).alias("k"), i.alias("i"), x["n"].alias("name"), x["v"].alias("value")))
    return F.when(n > 0, F.transform(F.array_sort(keyed), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:double>>"))


def by_span(names: Column, low: Column, high: Column) -> Column:
    """Names in the order of a tornado chart: the widest bar of both sides first."""
    return F.transform(ranked(names, F.zip_with(low, high, lambda a, b: F.abs(a) + F.abs(b))), lambda x: x["name"])
