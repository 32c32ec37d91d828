"""Rescaling of number columns. Each fit is one aggregation, each transform a projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.dataset import DISCRETE, Dataset, Stage, one_row
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.stats import normal_quantile
from plumbline.session import ship


@dataclass
class MinMax(Stage):
    """(x - min) / (max - min); a constant column becomes 0."""

    name: str = "minmax"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        return one_row(ds.df, {f"{a}|{f}": g(f) for f in targets for a, g in (("lo", F.min), ("hi", F.max))})

    def columns(self, targets: list[str]) -> dict[str, Column]:
        s = self.state
        return {f: (F.col(f) - F.lit(s[f"lo|{f}"])) / F.lit(float((s[f"hi|{f}"] - s[f"lo|{f}"]) or 1) if s[f"lo|{f}"] is not None else None) for f in targets}


@dataclass
class Standard(Stage):
    """(x - mean) / population deviation; a constant column becomes 0."""

    name: str = "standard"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        return one_row(ds.df, {f"{a}|{f}": g(f) for f in targets for a, g in (("mu", F.avg), ("sd", F.stddev_pop))})

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f: (F.col(f) - F.lit(self.state[f"mu|{f}"])) / F.lit(self.state[f"sd|{f}"] or 1.0) for f in targets}


def unscaled(c: Column, stage: MinMax | Standard, feature: str) -> Column:
    """A rescaled value on its old scale, by the state of the fitted stage."""
    s = stage.state
    if isinstance(stage, Standard):
        return c * F.lit(s[f"sd|{feature}"] or 1.0) + F.lit(s[f"mu|{feature}"])
    return c * F.lit(float((s[f"hi|{feature}"] - s[f"lo|{feature}"]) or 1)) + F.lit(s[f"lo|{feature}"])


@dataclass
class Robust(Stage):
    """(x - median) / (upper - lower quantile). Quantiles are fractions; ``percent`` reads them as percentages."""

    name: str = "robust"
    low: float = 0.25
    high: float = 0.75
    percent: bool = False

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        k = 100 if self.percent else 1
        return {"q": exact_quantiles(ds.df, {f: [self.low / k, 0.5, self.high / k] for f in targets})}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        out = {}
        for f in targets:
            lo, mid, hi = self.state["q"][f] or (None, None, None)
            out[f] = (F.col(f) - F.lit(mid)) / F.lit(((hi - lo) or 1.0) if mid is not None else None)
        return out


@dataclass
class Normalize(Stage):
    """Rows divided by their Euclidean length over the targets; a row of zeros stays."""

    name: str = "normalize"

    def columns(self, targets: list[str]) -> dict[str, Column]:
        length = F.sqrt(reduce(lambda a, b: a + b, [F.col(f) * F.col(f) for f in targets]))
        return {f: F.when(length == 0, F.col(f).cast("double")).otherwise(F.col(f) / length) for f in targets}


def interpolated(refs: np.ndarray, at: np.ndarray):
    """The place of a value among sorted references, as a vectorised function over Arrow batches: a bisection of a
    table of a bounded size, which plain expressions would interpret step by step."""
    ship(SparkSession.getActiveSession())
    upside, downside = -refs[::-1], -at[::-1]

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        p = 0.5 * (np.interp(v, refs, at) - np.interp(-v, upside, downside))
        return pd.Series(np.where(v <= refs[0], 0.0, np.where(v >= refs[-1], 1.0, p)))

    return place


@dataclass
class Quantile(Stage):
    """Values mapped by the empirical distribution to uniform or normal.

    The references are exact quantiles of all rows. Inside a run of equal
    references the map takes the middle of the run. The ends map to 0 and 1; normal ends are clipped at 1e-7.
    """

    name: str = "quantile"
    n_quantiles: int = 1000
    output: str = "uniform"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        n = ds.df.count()
        k = max(2, min(self.n_quantiles, n))
        at = np.linspace(0, 1, k)
        refs = exact_quantiles(ds.df, {f: at.tolist() for f in targets})
        return {"at": at, "refs": refs}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        at, out = self.state["at"], {}
        for f in targets:
            refs = self.state["refs"][f]
            if not refs:
                out[f] = F.lit(None).cast("double")
                continue
            x = F.col(f).cast("double")
            p = F.when(x.isNotNull() & ~F.isnan(x), interpolated(np.asarray(refs, float), at)(x))
            out[f] = normal_quantile(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))) if self.output == "normal" else p
        return out


@dataclass
class Bins(Stage):
    """Number columns cut into ``n_bins`` bins of equal width or equal weight."""

    name: str = "bins"
    gives: str = DISCRETE
    n_bins: int = 5
    strategy: str = "uniform"

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        if self.strategy == "uniform":
            return one_row(ds.df, {f"{a}|{f}": g(f) for f in targets for a, g in (("lo", F.min), ("hi", F.max))})
        return {"edges": exact_quantiles(ds.df, {f: [k / self.n_bins for k in range(self.n_bins + 1)] for f in targets})}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        out = {}
        for f in targets:
            if self.strategy == "uniform":
                lo, hi = self.state[f"lo|{f}"], self.state[f"hi|{f}"]
                if lo is None or lo == hi:
                    out[f] = F.when(F.col(f).isNotNull(), F.lit(0.0))
                    continue
                step = (hi - lo) / self.n_bins
                out[f] = F.least(F.lit(self.n_bins - 1.0), F.greatest(F.lit(0.0), F.floor((F.col(f) - F.lit(lo)) / F.lit(float(step))).cast("double")))
                out[f] = F.when(F.col(f).isNotNull(), out[f])
            else:
                edges = sorted(set(self.state["edges"][f] or []))[1:-1]
                out[f] = F.when(F.col(f).isNotNull(), reduce(lambda a, b: a + b, [(F.col(f) >= F.lit(e)).cast("double") for e in edges], F.lit(0.0)))
        return out
