"""Pseudo-random columns that depend on row keys only.

Results are the same under any partitioning, on any retry and on any other SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = float(1 << 52)


def digest(*parts) -> Column:
    """md5 of the parts joined by '|'."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def uniform(*parts) -> Column:
    """A number in (0, 1) from the first 52 bits of the digest."""
    bits = F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(_STEPS)


def gaussian(*parts) -> Column:
    """A standard normal number (Box-Muller over two independent uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "angle"))
