"""Column-expression builders shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (stable across engines)."""
    return F.round(col(c), 6) + F.lit(0.0)


def div0(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double with 0 when undefined (zero_division=0 semantics)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def sigmoid(z: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def log_sigmoid(z: str | Column) -> Column:
    """Numerically stable log(sigmoid(z)) = min(z, 0) - log1p(exp(-|z|))."""
    z = col(z)
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def softplus(z: str | Column) -> Column:
    z = col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bce_with_logits(z: str | Column, y: str | Column, pos_weight: Column | float = 1.0) -> Column:
    """-(w*y*log(sigma(z)) + (1-y)*log(sigma(-z)))."""
    z, y = col(z), col(y).cast("double")
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return -(w * y * log_sigmoid(z) + (F.lit(1.0) - y) * log_sigmoid(-z))


def hash_order_key(seed: int | str, *keys: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5 of ``seed:key...`` (hex string)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def hex_bucket(hex_col: str | Column, digits: int) -> Column:
    """Leading ``digits`` hex characters as an integer; monotone in the hex order."""
    return F.conv(F.substring(col(hex_col), 1, digits), 16, 10).cast("int")


def score_bucket(x: str | Column, buckets: int, descending: bool = False) -> Column:
    """Coarse bucket of a score in [0, 1], equally wide in the logit between -40 and 40; monotone
    (reversed when ``descending``). Scores that crowd at 0 or 1, as those of rare labels do, are
    as far apart in the logit as others, so they don't share one bucket."""
    p = F.least(F.greatest(col(x), F.lit(1e-300)), F.lit(1.0 - 1e-16))
    z = F.least(F.greatest(F.log(p) - F.log1p(-p), F.lit(-40.0)), F.lit(40.0))
    b = F.least(F.floor((z + F.lit(40.0)) * F.lit(buckets / 80.0)), F.lit(buckets - 1)).cast("int")
    return (F.lit(buckets - 1) - b) if descending else b
