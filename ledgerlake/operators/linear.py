"""Ridge regression whose penalty is chosen by leaving each row out, from one matrix of sums.

Missing values take the feature's median, features are centred and scaled. Tasks add up products of features and labels, so
what the driver sees is one number for each pair of features. Its eigenvectors give the coefficients of every penalty, and a
row's error had it been left out is e / (1 - h), with h from the same eigenvectors: one more pass adds these up for
all penalties at once, and no model is fitted again.

Rows without a label are not learnt from. A feature that is constant, or missing everywhere, has coefficient 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .trees import _values

PENALTIES = [10.0 ** (-1 + 5 * k / 19) for k in range(20)]


@dataclass
class Ridge:
    features: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    penalty: float
    errors: dict[float, float]

    def _parts(self) -> list[Column]:
        own = zip(self.features, self.medians, self.means, self.scales, self.coefficients, strict=True)
        return [(F.coalesce(_finite(f), F.lit(m)) - F.lit(a)) / F.lit(s) * F.lit(c) for f, m, a, s, c in own]

    def transform(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, sum(self._parts(), F.lit(self.intercept)))

    def drivers(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """keys, feature, contribution: with the intercept they add up to the prediction."""
        each = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("contribution")) for f, c in zip(self.features, self._parts(), strict=True)])
        return rows.select(*keys, F.explode(each).alias("z")).select(*keys, "z.feature", "z.contribution")


def _finite(f: str) -> Column:
    v = F.col(f).cast("double")
    return F.when(~F.isnan(v), v)


def medians_of(rows: DataFrame, features: list[str]) -> list[float]:
    """The exact median of each feature; 0 where it has no value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), _finite(f).alias("value")) for k, f in enumerate(features)])).alias("z")
    found = {r["feature"]: r["m"] for r in W.group_median(rows.select(each).select("z.*"), "value", ["feature"], "m").collect()}  # a row for each feature
    return [float(found.get(k, 0.0)) for k in range(len(features))]


def ridge(rows: DataFrame, features: list[str], label: str, penalties: list[float] | None = None) -> Ridge:
    """The model with the penalty of least mean squared error over left-out rows; `errors` has that of every penalty."""
    penalties = list(penalties or PENALTIES)
    p = len(features)
    x = rows.select(*[_finite(f).alias(f"f{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y")).where("y is not null")
    names = [f"f{k}" for k in range(p)]
    medians = np.array(medians_of(x, names))

    def filled(b) -> np.ndarray:
        v = _values(b, names)
        return np.where(np.isnan(v), medians, v)

    def sums(batches):
        s = np.zeros((p + 2, p + 2))
        for b in batches:
            # measured from the medians, so that large values of little spread keep their digits
            z = np.column_stack([np.ones(b.num_rows), filled(b) - medians, b.column(b.schema.get_field_index("y")).to_numpy()])
            s += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.size)), pa.array(s.ravel())], names=["k", "s"])

    def together(of, size: int) -> np.ndarray:
        """Sums over all tasks, place by place."""
        got = x.mapInArrow(of, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(size)
        out[got["k"].to_numpy()] = got["s"].to_numpy()
        return out

    s = together(sums, (p + 2) ** 2).reshape(p + 2, p + 2)
    n = s[0, 0]
    if not n:
        raise ValueError("no row with a label")
    mean = s[0, 1:] / n
    centred = s[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:p], 0) / n)
    constant = spread <= 1e-12 * np.maximum(1.0, np.abs(mean[:p]))
    scale = np.where(constant, 1.0, spread)
    gram = centred[:p, :p] / np.outer(scale, scale)
    gram[constant], gram[:, constant] = 0.0, 0.0
    target = np.where(constant, 0.0, centred[:p, p] / scale)
    d, v = np.linalg.eigh(gram)
    d = np.maximum(d, 0.0)
    shrunk = np.array([1 / (d + a) for a in penalties])
    turned = v.T @ target
    means = mean[:p] + medians

    def left_out(batches):
        total = np.zeros(len(penalties))
        for b in batches:
            z = np.where(constant, 0.0, (filled(b) - means) / scale) @ v
            y = b.column(b.schema.get_field_index("y")).to_numpy() - mean[p]
            for k in range(len(penalties)):
                h = 1 / n + (z * z) @ shrunk[k]
                total[k] += (((y - z @ (shrunk[k] * turned)) / np.maximum(1 - h, 1e-12)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "s"])

    errors = together(left_out, len(penalties)) / n
    best = int(errors.argmin())
    coefficients = v @ (shrunk[best] * turned)
    return Ridge(list(features), medians.tolist(), means.tolist(), scale.tolist(), coefficients.tolist(), float(mean[p]), penalties[best], dict(zip(penalties, errors.tolist(), strict=True)))
