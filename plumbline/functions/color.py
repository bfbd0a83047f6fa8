"""Colour arithmetic on #rrggbb strings, and polygon area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")


def rgb_hex(*rgb: Column) -> Column:
    parts = [F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x).cast("int"))))), 2, "0") for x in rgb]
    return F.concat(F.lit("#"), *parts)


def mix(a: Column, b: Column, t: Column) -> Column:
    """Linear blend; 0 is a, 1 is b."""
    return rgb_hex(*[channel(a, i) + (channel(b, i) - channel(a, i)) * t for i in range(3)])


def lighten(c: Column, t) -> Column:
    return mix(c, F.lit("#ffffff"), F.lit(t))


def darken(c: Column, t) -> Column:
    return mix(c, F.lit("#000000"), F.lit(t))


def luminance(c: Column) -> Column:
    return (0.2126 * channel(c, 0) + 0.7152 * channel(c, 1) + 0.0722 * channel(c, 2)) / 255.0


#: Text colours on dark and light grounds and the luminance between them; steps and
#: shares of the loops that lighten a colour, or push it away from its ground.
TEXT_ON_DARK, TEXT_ON_LIGHT, DARK_BELOW = "#f2f4f7", "#1b1f24", 0.45
LIGHTEN_STEPS, LIGHTEN_BY = 12, 0.16
CONTRAST_STEPS, CONTRAST_BY, CONTRAST_DELTA = 14, 0.14, 0.26


def readable_on(background: Column) -> Column:
    return F.when(luminance(background) < DARK_BELOW, TEXT_ON_DARK).otherwise(TEXT_ON_LIGHT)


def min_luminance(c: Column, floor: float) -> Column:
    """Lightened in up to twelve steps until bright enough."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(LIGHTEN_STEPS)), c, lambda x, _: F.when(luminance(x) >= floor, x).otherwise(lighten(x, LIGHTEN_BY)))


def contrast_on(c: Column, background: Column, delta: float = CONTRAST_DELTA) -> Column:
    """Pushed away from the background in up to fourteen steps."""
    bg = luminance(background)
    return F.aggregate(F.sequence(F.lit(1), F.lit(CONTRAST_STEPS)), c, lambda x, _: F.when(F.abs(luminance(x) - bg) >= delta, x).when(bg > 0.5, darken(x, CONTRAST_BY)).otherwise(lighten(x, CONTRAST_BY)))


def ramp(base: Column, n: int) -> Column:
    """n colours interpolated along an array of at least three."""
    last = F.size(base) - 1

    def one(i):
        t = i * last / F.lit(max(n - 1, 1))
        lo = F.floor(t).cast("int")
        return mix(F.element_at(base, lo + 1), F.element_at(base, F.least(lo + 1, last) + 1), t - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y)."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, n - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
