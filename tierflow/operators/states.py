"""Observation vectors: scaling, projection, quantile bins, state keys.

A fitted step is a few numbers per dimension.  They are read to the driver as
model parameters, the way any fitted transformer keeps them.
"""

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.operators.percentiles import exact_percentiles

# How the two policies keep a deviation away from zero, and the
# newest version of stored models.
STD_OFFSET = 1e-8
STD_FLOOR = 1e-6
NEWEST_VERSION = 3


def doubles(column: str) -> Column:
    return F.col(column).cast("array<double>")


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per dimension."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def apply(self, vector: Column) -> Column:
        """Scaled vector; a vector of another length stays as it is."""
        mean, std = F.lit(list(self.mean)), F.lit(list(self.std))
        centred = F.zip_with(vector, mean, lambda x, m: x - m)
        scaled = F.zip_with(centred, std, lambda x, s: x / s)
        return F.when(F.size(vector) == len(self.mean), scaled).otherwise(vector)


def fit_scaler(df: DataFrame, vector: str, floor: bool = False) -> Scaler:
    """One pass over the vectors without exploding them."""
    metrics = Summarizer.metrics("mean", "variance", "count")
    row = (
        df.select(array_to_vector(doubles(vector)).alias("_v"))
        .agg(metrics.summary(F.col("_v")).alias("_s"))
        .select(
            vector_to_array("_s.mean").alias("mean"),
            vector_to_array("_s.variance").alias("variance"),
            F.col("_s.count").alias("n"),
        )
        .first()
    )
    population = (row["n"] - 1) / row["n"]
    std = [(v * population) ** 0.5 for v in row["variance"]]
    kept = [max(s, STD_FLOOR) if floor else s + STD_OFFSET for s in std]
    return Scaler(tuple(row["mean"]), tuple(kept))


@dataclass(frozen=True)
class Projection:
    """Scaling and projection on principal axes in one native step.

    The fitted model neither scales nor centres, so the vector is divided by
    the deviations first and the projected mean is taken off at the end.
    ``signs`` turns each axis so that its largest loading is positive.
    """

    model: PCAModel
    std: tuple[float, ...]
    signs: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.signs)

    def apply(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        """Add the array ``name`` with one number per axis."""
        scaled = divided(df, vector, self.std, "_scaled")
        along = vector_to_array("_axes")
        turned = F.zip_with(along, F.lit(list(self.signs)), lambda x, s: x * s)
        centred = F.zip_with(turned, F.lit(list(self.offset)), lambda x, o: x - o)
        return self.model.transform(scaled).withColumn(name, centred).drop("_scaled", "_axes")


def divided(df: DataFrame, vector: str, std: Sequence[float], name: str) -> DataFrame:
    """Add the vector divided by the deviations as an ML vector column."""
    product = ElementwiseProduct(
        scalingVec=Vectors.dense([1.0 / s for s in std]), inputCol="_raw", outputCol=name
    )
    raw = df.withColumn("_raw", array_to_vector(doubles(vector)))
    return product.transform(raw).drop("_raw")


def fit_projection(df: DataFrame, vector: str, scaler: Scaler, components: int) -> Projection:
    """Principal axes of the scaled vectors."""
    k = min(int(components), len(scaler.mean))
    if k <= 0:
        raise ValueError(f"invalid number of components: {components}")
    scaled = divided(df.select(vector), vector, scaler.std, "_scaled")
    model = PCA(k=k, inputCol="_scaled", outputCol="_axes").fit(scaled)
    axes = model.pc.toArray()
    signs = [1.0 if a.max() >= -a.min() else -1.0 for a in axes.T]
    centre = np.array(scaler.mean) / np.array(scaler.std)
    offset = (centre @ axes) * np.array(signs)
    return Projection(model, tuple(scaler.std), tuple(signs), tuple(float(o) for o in offset))


@dataclass(frozen=True)
class QuantileBins:
    """Inner edges per component; values outside fall into the end bins."""

    edges: tuple[tuple[float, ...], ...]

    def apply(self, components: Sequence[Column]) -> Column:
        """Array of bin numbers."""
        return F.array(
            *[
                reduce(Column.__add__, [(value >= e).cast("int") for e in inner], F.lit(0))
                for value, inner in zip(components, self.edges)
            ]
        )


def fit_bins(
    df: DataFrame, components: Sequence[Column], n_bins: int
) -> QuantileBins:
    """Exact quantile edges of each component.

    Equal edges collapse; the lowest and highest remaining edge only close the
    end bins.
    """
    pairs = F.array(
        *[F.struct(F.lit(i).alias("dim"), c.alias("x")) for i, c in enumerate(components)]
    )
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*")
    levels = [i / n_bins for i in range(n_bins + 1)]
    rows = exact_percentiles(long, ["dim"], "x", levels).collect()
    found = [sorted({r["percentile"] for r in rows if r["dim"] == i}) for i in range(len(components))]
    return QuantileBins(tuple(tuple(edges[1:-1]) for edges in found))


def state_key(bins: Column) -> Column:
    return F.array_join(bins.cast("array<string>"), ",")


def observation(system: Sequence[str], embedding: str) -> Column:
    """System readings followed by the embedding, one vector."""
    readings = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in system])
    return F.concat(readings, doubles(embedding))


def compatible(scaler: Scaler | None, obs_dim: int | None, version: int | None = None) -> bool:
    """Whether fitted steps may be used: a scaler of the declared length."""
    if scaler is None or not scaler.mean or not scaler.std:
        return False
    if version is not None and version > NEWEST_VERSION:
        warnings.warn(f"model version {version} is newer than {NEWEST_VERSION}", stacklevel=2)
    return obs_dim is None or obs_dim == len(scaler.mean)
