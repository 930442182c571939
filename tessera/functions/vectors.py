"""Vector expressions over ``array<float|double>`` columns, JVM-side.

PySpark has no vector built-ins for array columns, so dot products are
``zip_with`` + ``aggregate`` higher-order functions; every product is taken in
DOUBLE.  Cosine is ``dot / sqrt(|a|^2 * |b|^2)`` and NULL when either vector is
zero (never NaN, never a division error under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: _d(x) * _d(y))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + _d(x) * _d(x))


def cosine_from_parts(dot_ab: Column, na: Column, nb: Column) -> Column:
    return F.when((na > 0) & (nb > 0), dot_ab / F.sqrt(na * nb))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """``1 - cosine_distance(a, b)``; NULL for a zero vector."""
    na = norm_sq(a) if na is None else na
    nb = norm_sq(b) if nb is None else nb
    return cosine_from_parts(dot(a, b), na, nb)


# ---------------------------------------------------------------------------
# sparse-aware dot products
#
# Every vector is stored with ``nz``, the 0-based indices of its non-zero
# components.  A dot product walks the non-zeros of the sparser side and reads
# the other side by position (O(1)), so a 15-token sentence against a 256-d
# hashing vector costs ~15 steps instead of 512.


def nonzero_indices(a: Column) -> Column:
    """0-based positions of the non-zero components of ``a``."""
    n = F.size(a)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(idx, lambda i: F.element_at(a, i + 1) != 0)


def _walk(a: Column, a_nz: Column, b: Column) -> Column:
    return F.aggregate(a_nz, F.lit(0.0).cast("double"),
                       lambda acc, i: acc + _d(F.element_at(a, i + 1)) * _d(F.element_at(b, i + 1)))


def sparse_dot(a: Column, a_nz: Column, b: Column, b_nz: Column) -> Column:
    return F.when(F.size(a_nz) <= F.size(b_nz), _walk(a, a_nz, b)).otherwise(_walk(b, b_nz, a))


def sparse_cosine(a: Column, a_nz: Column, na: Column, b: Column, b_nz: Column, nb: Column) -> Column:
    """Cosine of two stored vectors (``vec``, ``nz``, ``norm_sq``); NULL if either is zero."""
    return F.when((na > 0) & (nb > 0), sparse_dot(a, a_nz, b, b_nz) / F.sqrt(na * nb))


def side(prefix: str = "") -> tuple[Column, Column, Column]:
    """The (vec, nz, norm_sq) columns of a vector table, optionally prefixed."""
    return F.col(prefix + "vec"), F.col(prefix + "nz"), F.col(prefix + "norm_sq")


def cosine_between(left: str, right: str) -> Column:
    return sparse_cosine(*side(left), *side(right))
