"""Column -> Column functions over probability / embedding arrays (native higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _col(c).cast("array<double>")


def softmax(c, scale: float = 1.0) -> Column:
    """softmax(scale * x) of a numeric array."""
    x = F.transform(as_double_array(c), lambda v: F.exp(v * F.lit(scale)))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.transform(x, lambda v: v / total)


def blend(client, counselor, alpha: float = D.BLEND_ALPHA) -> Column:
    """``alpha * client + (1 - alpha) * counselor``, element-wise."""
    return F.zip_with(as_double_array(client), as_double_array(counselor),
                      lambda a, b: F.lit(alpha) * a + F.lit(1.0 - alpha) * b)


def index_sum(c, idx) -> Column:
    """Sum of the entries at 0-based positions ``idx``."""
    arr = as_double_array(c)
    expr = F.lit(0.0)
    for i in idx:
        expr = expr + F.coalesce(F.try_element_at(arr, F.lit(i + 1)), F.lit(0.0))
    return expr


def probability_tier(c, negative_idx=None, crisis_idx=None,
                     crisis_cut: float = D.CRISIS_CUT, negative_cuts=None) -> Column:
    """Tier from a class-probability vector (strict comparisons, crisis first)."""
    crisis = index_sum(c, crisis_idx or D.CRISIS_IDX)
    neg = index_sum(c, negative_idx or D.NEGATIVE_IDX)
    cuts = negative_cuts or D.NEGATIVE_CUTS
    expr = F.when(crisis > F.lit(crisis_cut), F.lit(5))
    for tier in sorted(cuts, reverse=True):
        expr = expr.when(neg > F.lit(cuts[tier]), F.lit(tier))
    return expr.otherwise(F.lit(1))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_normalize(c) -> Column:
    arr = as_double_array(c)
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v * v))
    # an array of one norm, so that it is summed up once and not for every entry
    return F.transform(F.array(norm), lambda n: F.transform(arr, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))[0]
