"""Array-of-double helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

UNROLL = 256


def quoted(name: str) -> Column:
    """Column by exact name (one-hot level names may hold dots or dashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def assemble(names: Sequence[str]) -> Column:
    return F.array(*[quoted(n).cast("double") for n in names])


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    """Inner product. A known small width is unrolled, which keeps it inside generated code."""
    if width is not None and width <= UNROLL:
        total = F.lit(0.0)
        for i in range(width):
            total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
