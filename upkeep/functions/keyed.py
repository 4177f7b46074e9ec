"""Keyed uniform and Gaussian numbers.

Random choices are functions of a row key and a seed, never of ``rand()``, so results do
not depend on partitioning or retries (a lost executor recomputes the same numbers) and
the same expression gives the same number in the SQL oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def uniform_of(text: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of md5(text)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def key_text(*parts, seed) -> Column:
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))


def uniform(*parts, seed) -> Column:
    return uniform_of(key_text(*parts, seed=seed))


def gaussian(*parts, seed) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = uniform_of(F.concat(key_text(*parts, seed=seed), F.lit("|g1")))
    u2 = uniform_of(F.concat(key_text(*parts, seed=seed), F.lit("|g2")))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def randint(lo: int, hi_exclusive: int, *parts, seed) -> Column:
    """Integer in [lo, hi) (numpy ``randint`` convention)."""
    return (F.floor(uniform(*parts, seed=seed) * (hi_exclusive - lo)) + lo).cast("long")
