"""Counter-based randomness: every draw is a hash of (seed, namespace, key, draw number).

Rows come out the same for any number of partitions, because nothing but the key decides them.
The hash is the splitmix64 finaliser, four times; the two rounds that don't depend on the row
are folded on the driver. 64-bit products must wrap, so they are built with ANSI mode off
(the mode is part of the built expression); each step is a projection of its own, because a step
uses its input twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FNV-1a 64-bit, splitmix64.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1

# Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def signed(x: int) -> int:
    """The bigint with the 64 bits of x."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def fnv1a64(text: str) -> int:
    h = FNV_OFFSET
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME & MASK
    return h


def mix64(z: int) -> int:
    z = (z ^ z >> 30) * MIX_1 & MASK
    z = (z ^ z >> 27) * MIX_2 & MASK
    return z ^ z >> 31


def salt(seed: int, namespace: str) -> int:
    """What the rounds before the key make of seed and namespace."""
    return mix64(mix64(seed & MASK ^ GOLDEN) ^ fnv1a64(namespace))


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Inside, integer arithmetic wraps. Frames must be analysed (have .schema read) before the end."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_hashes(df: DataFrame, key: str, draws: dict[str, int], seed_draw: int = 0) -> DataFrame:
    """df with a bigint column for each of draws (name: salt), the hash of key under that salt."""
    if not draws:
        return df
    kept = [F.col(f"`{c}`") for c in df.columns]
    steps = [
        lambda n, s: F.col(key).bitwiseXOR(F.lit(signed(s))),
        *[lambda n, s, shift=shift, by=by: F.col(n).bitwiseXOR(F.shiftrightunsigned(F.col(n), shift)) * F.lit(signed(by)) for shift, by in ((30, MIX_1), (27, MIX_2))],
        lambda n, s: F.col(n).bitwiseXOR(F.shiftrightunsigned(F.col(n), 31)).bitwiseXOR(F.lit(signed(seed_draw))),
        *[lambda n, s, shift=shift, by=by: F.col(n).bitwiseXOR(F.shiftrightunsigned(F.col(n), shift)) * F.lit(signed(by)) for shift, by in ((30, MIX_1), (27, MIX_2))],
        lambda n, s: F.col(n).bitwiseXOR(F.shiftrightunsigned(F.col(n), 31)),
    ]
    with wrapping(df.sparkSession):
        for step in steps:
            df = df.select(*kept, *(step(n, s).alias(n) for n, s in draws.items()))
        _ = df.schema
    return df


def uniform(hashed: Column) -> Column:
    """(0, 1) from the upper 53 bits."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) * 2.0**-53


def with_uniforms(df: DataFrame, key: str, seed: int, draws: dict[str, str]) -> DataFrame:
    """df with a uniform column for each of draws (name: namespace).

    The uniforms pass through inline(): a filter on them is not pushed below it, where the
    optimizer would write out the hash, twice its size at each step.
    """
    if not draws:
        return df
    hashed = with_hashes(df, key, {n: salt(seed, ns) for n, ns in draws.items()})
    kept = [F.col(f"`{c}`") for c in df.columns]
    return hashed.select(*kept, F.inline(F.array(F.struct(*(uniform(F.col(f"`{n}`")).alias(n) for n in draws)))))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inv_norm(u: Column) -> Column:
    """Standard normal quantile of u; NaN outside (0, 1)."""

    def tail(p: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(p))
        return _horner(ACKLAM_C, q) / _horner((*ACKLAM_D, 1.0), q)

    q = u - 0.5
    middle = _horner(ACKLAM_A, q * q) * q / _horner((*ACKLAM_B, 1.0), q * q)
    inside = F.when(u < ACKLAM_LOW, tail(u)).when(u > 1 - ACKLAM_LOW, -tail(1.0 - u)).otherwise(middle)
    return F.when((u > 0) & (u < 1), inside).otherwise(F.when(u.isNotNull(), F.lit(float("nan"))))
