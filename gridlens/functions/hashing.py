"""Repeatable randomness from row ids.

``rand()`` depends on how rows are partitioned, so a re-run after a lost
executor would give other values. Here each draw is a function of (row id, seed)
in plain integer arithmetic: it stays in generated code and any SQL engine can
recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mersenne prime 2^31-1 and three multipliers of full period below it.
M31 = 2147483647
MULTIPLIERS = (48271, 69621, 39373)


def _column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def _xorshift(h: Column, bits: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, bits))


def hash31(key: Column | str, seed: int) -> Column:
    """Integer in [0, 2^31-1) that mixes a bigint row id with a seed."""
    key = _column(key).cast("bigint")
    low = F.pmod(key, F.lit(M31))
    high = F.pmod(F.shiftright(key, 31), F.lit(M31))
    h = F.pmod(low * MULTIPLIERS[0] + high * MULTIPLIERS[2] + F.lit((seed * 1000003 + 12345) % M31), F.lit(M31))
    h = F.pmod(_xorshift(h, 15) * MULTIPLIERS[1] + F.lit((seed * 7919 + 777) % M31), F.lit(M31))
    return F.pmod(_xorshift(h, 13) * MULTIPLIERS[2], F.lit(M31))


def unit(key: Column | str, seed: int) -> Column:
    """Uniform double in the open interval (0, 1)."""
    return (hash31(key, seed) + 0.5) / F.lit(2147483648.0)


def signed(key: Column | str, seed: int) -> Column:
    """-1.0 or 1.0 with equal probability."""
    return F.when(unit(key, seed) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def gaussian(key: Column | str, seed: int) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(unit(key, seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * unit(key, seed + 104729))


def laplace(key: Column | str, seed: int, scale: Column | float) -> Column:
    """Laplace(0, scale) by the inverse distribution function."""
    centred = unit(key, seed) - 0.5
    return -F.signum(centred) * scale * F.log(F.lit(1.0) - F.abs(centred) * 2.0)


def hash31_sql(key: str, seed: int) -> str:
    """The same integer as :func:`hash31` as SQL text for another engine."""
    a, b, c = MULTIPLIERS
    low, high = f"(CAST({key} AS BIGINT) % {M31})", f"((CAST({key} AS BIGINT) >> 31) % {M31})"
    h1 = f"(({low} * {a} + {high} * {c} + {(seed * 1000003 + 12345) % M31}) % {M31})"
    h2 = f"((xor({h1}, {h1} >> 15) * {b} + {(seed * 7919 + 777) % M31}) % {M31})"
    return f"((xor({h2}, {h2} >> 13) * {c}) % {M31})"


def unit_sql(key: str, seed: int) -> str:
    return f"(({hash31_sql(key, seed)} + 0.5) / 2147483648.0::DOUBLE)"


def gaussian_sql(key: str, seed: int) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({unit_sql(key, seed)})) * "
        f"cos(2.0::DOUBLE * pi() * {unit_sql(key, seed + 104729)}))"
    )


def signed_sql(key: str, seed: int) -> str:
    return f"(CASE WHEN {unit_sql(key, seed)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"


def laplace_sql(key: str, seed: int, scale: str) -> str:
    u = f"({unit_sql(key, seed)} - 0.5::DOUBLE)"
    return f"(-sign({u}) * ({scale}) * ln(1.0::DOUBLE - abs({u}) * 2.0::DOUBLE))"
