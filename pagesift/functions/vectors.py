"""Vector expressions (F5-F8) as JVM-side higher-order functions.

These are the definitions; the batched scorer in ``operators.topk`` computes
the same numbers with one matrix product per Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """dot product of two equal-length arrays (double arithmetic)."""
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def sq_norm(a) -> Column:
    return F.aggregate(F.transform(as_double_array(a), lambda x: x * x),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    """Euclidean distance."""
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """cosine similarity; NULL when either norm is zero."""
    denom = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(denom > 0, dot(a, b) / denom)
