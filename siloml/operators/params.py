"""Model parameters as a long table (round, client_id, layer, pos, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siloml.spec import CLIENT

SCHEMA = f"round int, {CLIENT} int, layer int, pos int, value double"
WEIGHTS, INTERCEPT = 0, 1


def init_zero(silos: DataFrame, width: int) -> DataFrame:
    """Round-0 linear parameters: ``width`` zero weights and a zero intercept for every silo in the frame."""
    layers = F.array(F.array_repeat(F.lit(0.0), width), F.array(F.lit(0.0)))
    return silos.select(CLIENT).distinct().select(CLIENT, F.posexplode(layers).alias("layer", "vector")).select(
        F.lit(0).alias("round"), CLIENT, "layer",
        F.posexplode("vector").alias("pos", "value"),
    )


def flatten_params(vectors: DataFrame, value: str = "vector") -> DataFrame:
    """(round, client_id, array) -> one-layer long rows."""
    return vectors.select(
        "round", CLIENT, F.lit(0).alias("layer"), F.posexplode(value).alias("pos", "value")
    )


def rebuild_params(params: DataFrame, keys: Sequence[str] = ("round", CLIENT)) -> DataFrame:
    """Long rows -> one array per key, ordered by (layer, pos)."""
    packed = params.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("layer", "pos", "value"))).alias("_p"))
    return packed.select(*keys, F.col("_p.value").alias("vector"))


def shape_params(flat: DataFrame, inputs: int, hidden: int, outputs: int = 1) -> DataFrame:
    """One-layer network vector -> layers w1 (0), w2 (1), b1 (2), b2 (3), cut in that order.

    An all-zero one-element vector (the untouched start value) is passed through.
    """
    sizes = [inputs * hidden, hidden * outputs, hidden, outputs]
    ends = [sum(sizes[: i + 1]) for i in range(4)]
    layer = F.lit(3)
    start = F.lit(ends[2])
    for i in (2, 1, 0):
        layer = F.when(F.col("pos") < ends[i], F.lit(i)).otherwise(layer)
        start = F.when(F.col("pos") < ends[i], F.lit(ends[i] - sizes[i])).otherwise(start)
    return flat.select("round", CLIENT, layer.alias("layer"), (F.col("pos") - start).alias("pos"), "value")


def linear_table(fits: DataFrame, width: int, round_no: int) -> DataFrame:
    """(client_id, vector [w..., b]) -> long rows of two layers."""
    layers = F.array(F.slice("vector", 1, width), F.slice("vector", width + 1, 1))
    return fits.select(CLIENT, F.posexplode(layers).alias("layer", "part")).select(
        F.lit(round_no).alias("round"), CLIENT, "layer", F.posexplode("part").alias("pos", "value"))
