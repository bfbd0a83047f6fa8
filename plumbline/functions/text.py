"""Scalar expressions on names, numbers, JSON and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("de", "en")
DEFAULT_LANGUAGE = "de"


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]+$", "")


def language(name: Column) -> Column:
    """The flag behind the last underscore of the stem, or the default."""
    tail = F.lower(F.element_at(F.split(stem(name), "_"), -1))
    return F.when(tail.isin(*LANGUAGES), tail).otherwise(F.lit(DEFAULT_LANGUAGE))


def doc_of(name: Column) -> Column:
    """Document key: the name before the first double underscore."""
    return F.substring_index(F.element_at(F.split(name, "/"), -1), "__", 1)


def report_stem(name: Column) -> Column:
    return F.substring_index(stem(name), "__", 1)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]+$", 0))


def joined(root: Column, *parts: Column) -> Column:
    """A path below ``root``; an absolute part starts anew, as path libraries have it."""
    out = root
    for part in parts:
        out = F.when(part.startswith("/"), part).otherwise(F.concat(out, F.lit("/"), part))
    return out


def normalized(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; ``..`` above the top is dropped."""
    start = F.array().cast("array<string>")

    def step(a, s):
        up = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(s.isin("", "."), a).when(s == "..", up).otherwise(F.array_append(a, s))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), start, step), "/"))


def within(path: Column, root: Column) -> Column:
    """Whether an absolute path, normalised, is the root or below it."""
    p, r = normalized(path), normalized(root)
    return (p == r) | (r == "/") | p.startswith(F.concat(r, F.lit("/")))


def format_number(value: Column, decimals: int, locale: str) -> Column:
    """Grouped fixed-point text; German swaps point and comma."""
    s = F.format_number(value, decimals)
    return F.translate(s, ",.", ".,") if locale == "de" else s


def parse_number(text: Column, locale: str) -> Column:
    """Number of a grouped text; what is no number is 0."""
    s = F.translate(text, ".,", "_.") if locale == "de" else F.translate(text, ",", "_")
    return F.coalesce(F.regexp_replace(s, "[_ %+]", "").try_cast("double"), F.lit(0.0))


def python_round(value: Column, decimals: int) -> Column:
    """Correctly rounded half-even on the binary value."""
    return F.regexp_replace(F.format_number(value, decimals), ",", "").cast("double")


def decimals_for(value: Column, topic: Column) -> Column:
    """Decimals shrink as numbers grow."""
    a = F.abs(value)
    return F.when(a >= 1000, F.lit(0)).when(a >= 100, F.least(topic, F.lit(1))).otherwise(topic)


def signed(value: Column, decimals: int, locale: str) -> Column:
    s = format_number(value, decimals, locale)
    return F.when(value > 0, F.concat(F.lit("+"), s)).otherwise(s)


def json_object(content: Column) -> Column:
    """The reply itself if it is JSON, else its outermost braces, else null (as a variant)."""
    block = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(F.when(block != "", block)))


def year_labels(end: Column, n: int, short: bool = False) -> Column:
    years = F.sequence(end - n + 1, end)
    return F.transform(years, lambda y: F.concat(F.lit("'"), F.lpad((y % 100).cast("string"), 2, "0")) if short else y.cast("string"))


def quarter_labels(q0: Column, y0: Column, n: int, short: bool = False) -> Column:
    def one(i):
        q, y = (q0 - 1 + i) % 4 + 1, y0 + F.floor((q0 - 1 + i) / 4)
        tail = F.concat(F.lit("/"), F.lpad((y % 100).cast("string"), 2, "0")) if short else F.concat(F.lit(" "), y.cast("string"))
        return F.concat(F.lit("Q"), q.cast("string"), tail)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def tick_picks(n: Column, most: Column) -> Column:
    """Evenly spaced positions that include both ends."""
    step = (n - 1) / (most - 1)
    return F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), (most - 1).cast("int")), lambda i: F.bround(i * step).cast("int"))))


def caption(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 2), F.lit("…"))).otherwise(text)


def data_url(name: Column, content: Column) -> Column:
    """base64 data URL; the type follows the extension."""
    ext = suffix(name)
    mime = F.when(ext.isin(".jpg", ".jpeg"), "image/jpeg").when(ext == ".webp", "image/webp").when(ext == ".gif", "image/gif").when(ext == ".bmp", "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def run_stamp(folder: Column) -> Column:
    """Start time in a run folder's name, or null."""
    s = F.regexp_extract(folder, r"(\d{8}_\d{6})", 1)
    return F.when(s != "", F.try_to_timestamp(s, F.lit("yyyyMMdd_HHmmss"))).cast("timestamp_ntz")


def url_filename(url: Column) -> Column:
    """Last path part of a URL."""
    return F.element_at(F.split(F.regexp_extract(url, r"^[^?#]*", 0), "/"), -1)


def share_label(n: Column, total: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" ("), F.format_number(F.try_divide(100 * n, total), 1), F.lit(" %)"))
