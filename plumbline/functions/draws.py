"""Counter-based random draws: every value is a hash of (seed, stream, number), so a draw needs no
order and a lost task draws the same again."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: Column, stream: str, i: Column | int = 0) -> Column:
    """Uniform in [0, 1) with 32 bits, from an MD5 of the three."""
    i = F.lit(i) if isinstance(i, int) else i
    text = F.concat_ws("|", seed.cast("string"), F.lit(stream), i.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / (1 << 32)


def unit_sql(seed: str, stream: str, i: str = "0") -> str:
    return f"(CAST('0x' || substr(md5({seed} || '|{stream}|' || {i}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def uniform(u: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) * u


def integer(u: Column, lo: int, hi: int) -> Column:
    """Both ends included."""
    return (lo + F.floor(u * (hi - lo + 1))).cast("int")


def chance(u: Column, p: float) -> Column:
    return u < p


def normal(u: Column, v: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """Box-Muller of two uniforms."""
    return mu + sigma * F.sqrt(-2 * F.log(F.lit(1.0) - u)) * F.cos(2 * math.pi * v)


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """A key by cumulative weight."""
    total, upto, out = sum(weights.values()), 0.0, None
    for k, w in weights.items():
        upto += w
        test = u < upto / total
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out.otherwise(F.lit(list(weights)[-1]))


def weighted_sql(u: str, weights: dict[str, float]) -> str:
    total, upto, cases = sum(weights.values()), 0.0, []
    for k, w in weights.items():
        upto += w
        cases.append(f"WHEN {u} < {upto / total!r}::DOUBLE THEN '{k}'")
    return f"CASE {' '.join(cases)} ELSE '{list(weights)[-1]}' END"


def shuffled(items: Column, seed: Column, stream: str) -> Column:
    """An array in the order of its elements' hashes."""
    keyed = F.transform(items, lambda x, i: F.struct(unit(seed, stream, i).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def sample(items: Column, seed: Column, stream: str, k: int) -> Column:
    return F.slice(shuffled(items, seed, stream), 1, k)
