"""A two-dimensional PCA projection of embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Basis:
    """A mean and the leading components: d and k times d numbers."""

    mean: list[float]
    components: list[list[float]]

    def project(self, rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """Adds ``x`` and ``y``, without leaving the JVM."""
        mean = F.array(*[F.lit(float(m)) for m in self.mean])
        centred = F.zip_with(F.col(vector_col), mean, lambda a, b: a.cast("double") - b)
        for name, c in zip(("x", "y"), self.components, strict=True):
            axis = F.array(*[F.lit(float(v)) for v in c])
            rows = rows.withColumn(name, F.aggregate(F.zip_with(centred, axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        return rows


def fit(rows: DataFrame, vector_col: str = "embedding") -> Basis:
    """The two leading axes of the centred vectors; the largest loading of each is positive.

    The covariance is summed where the rows are; d times d numbers reach the driver.
    """
    vectors = rows.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    mean = vectors.agg(Summarizer.mean(F.col("v"))).first()[0].toArray()
    axes = PCA(k=2, inputCol="v", outputCol="p").fit(vectors).pc.toArray().T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return Basis(mean.tolist(), (axes * signs[:, None]).tolist())
