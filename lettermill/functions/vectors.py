"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def scale_to_unit(vector: Column, norm: Column) -> Column:
    """``vector / norm``; a zero vector stays as it is. ``norm`` should be a computed column."""
    return F.when(norm == 0.0, vector).otherwise(F.transform(vector, lambda v: v / norm))


def round_vector(vector: Column) -> Column:
    """The eight decimals a stored vector keeps."""
    return F.transform(vector, lambda v: F.round(v.cast("double"), 8))


def vector_literal(vector: Column) -> Column:
    """``[0.12345678,...]`` with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda v: F.format_string("%.8f", v.cast("double"))), ","), F.lit("]"))


def dense_from_sparse(entries: Column, dimensions: int) -> Column:
    """Zero-filled vector from bucket-sorted ``array<struct<bucket, weight>>``, in one pass over the entries."""

    def gap_then_weight(entry: Column, i: Column) -> Column:
        previous = F.coalesce(F.get(entries, i - 1)["bucket"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0.0), entry["bucket"] - previous - 1), F.array(entry["weight"]))

    last = F.coalesce(F.get(entries, F.size(entries) - 1)["bucket"], F.lit(-1))
    tail = F.array_repeat(F.lit(0.0), F.lit(dimensions - 1) - last)
    return F.concat(F.flatten(F.transform(entries, gap_then_weight)), tail)
