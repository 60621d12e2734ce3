"""Scalar column functions; all are built-in Spark expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_user_id(index, prefix: str = "user_", length: int = 8) -> Column:
    """First ``length`` hex chars of SHA-256 of ``prefix + index``."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), _c(index).cast("string")), 256), 1, length)


def confidence(strength, alpha: float) -> Column:
    """Implicit-feedback confidence ``1 + alpha * strength``."""
    return F.lit(1.0) + F.lit(float(alpha)) * _c(strength).cast("double")


def dot(a, b) -> Column:
    """M3: dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    """Unit-length copy of a vector; the zero vector stays zero."""
    # the length as a lambda's argument: written inside the inner lambda it would be summed for every element
    whole = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(_c(a), lambda x: F.lit(0.0))))
    return F.get(whole, 0)


def cosine(a, b) -> Column:
    """M5: cosine similarity; 0 when either vector has norm 0."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def l2_distance(a, b) -> Column:
    """Euclidean distance of two arrays."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def safe_div(num, den) -> Column:
    """Division that yields 0 for a zero or null denominator (ANSI-safe)."""
    den = _c(den)
    return F.when(den.isNull() | (den == 0), F.lit(0.0)).otherwise(_c(num) / den)


def sorted_json(m) -> Column:
    """JSON object text of a map with keys in sorted order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(m)))))
