"""Column expressions on vector columns."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from nearfield.params import check_metric
from nearfield.runtime import sorted_join


def _doubles(vector) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def l2_squared(a, b) -> Column:
    """Squared Euclidean distance of two vector columns."""
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def dot(a, b) -> Column:
    """Inner product of two vector columns."""
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def metric_score(a, b, metric: str = "l2") -> Column:
    """Score where smaller is nearer: squared distance, or the negated product."""
    return l2_squared(a, b) if check_metric(metric) == "l2" else -dot(a, b)


def norm2(a) -> Column:
    return F.aggregate(_doubles(a), F.lit(0.0), lambda total, x: total + x * x)


def clamp_distance(d) -> Column:
    """Lift tiny negative distances, which come from rounding, to zero."""
    d = F.col(d) if isinstance(d, str) else d
    return F.when((d < 0) & (d > -1e-4), F.lit(0.0)).otherwise(d)


def l2_from_norms(a, b, norm_a=None, norm_b=None) -> Column:
    """Squared distance from norms and the inner product, clamped at zero."""
    norm_a = norm2(a) if norm_a is None else norm_a
    norm_b = norm2(b) if norm_b is None else norm_b
    return clamp_distance(norm_a + norm_b - F.lit(2.0) * dot(a, b))


def checked_vector(vector, dim: int) -> Column:
    """The vector itself; raises at run time where its length is not ``dim``."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    message = F.concat(
        F.lit(f"dimension mismatch: expected {dim}, got "), F.size(vector).cast("string")
    )
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message))


def qps(count, seconds) -> Column:
    """Queries per second; zero without queries, and never a division by zero."""
    count = F.col(count) if isinstance(count, str) else count
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(count == 0, F.lit(0.0)).otherwise(count / F.greatest(F.lit(1e-6), seconds))


def valid_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges whose target is a known point other than the source."""
    known = points.select(F.col("vec_id").alias("dst"))
    others = edges.filter(F.col("src") != F.col("dst"))
    return sorted_join(others, known, "dst", "left_semi").select(*edges.columns)


def gaussian(key) -> Column:
    """A standard normal draw that depends on the string ``key`` alone."""
    digest = F.md5(key)
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    second = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    u1 = (first + F.lit(1)) / F.lit(4294967296.0)
    u2 = second / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hyperplanes(bits: int, dim: int, seed: int) -> list[list[float]]:
    """``bits`` Gaussian normals of length ``dim``; the same draw as ``gaussian``."""

    def draw(bit: int, axis: int) -> float:
        digest = hashlib.md5(f"{seed}:{bit}:{axis}".encode()).hexdigest()
        u1 = (int(digest[:8], 16) + 1) / 4294967296.0
        u2 = int(digest[8:16], 16) / 4294967296.0
        return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)

    return [[draw(bit, axis) for axis in range(dim)] for bit in range(bits)]


def residual_hash(source, target, planes: list[list[float]]) -> Column:
    """Sign bits of ``target - source`` against each plane, as a bigint code.

    ``source`` and ``target`` are the projections of the two vectors on the
    planes (see ``operators.prune.project``), so an edge costs ``bits``
    subtractions instead of ``bits`` inner products.
    """
    code = F.lit(0).cast("bigint")
    for bit in range(len(planes)):
        positive = F.element_at(target, bit + 1) - F.element_at(source, bit + 1) >= 0
        code = code + F.when(positive, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
    return code
