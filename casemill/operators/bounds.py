"""Credibility bounds that need special functions: Arrow UDFs over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.special import beta_quantile, gamma_p, gamma_quantile
from casemill.operators.contingency import ALPHA


def log_ratio_bound(observed: Column, expected: Column, q: float = 0.025, alpha: float = ALPHA) -> Column:
    """The q-quantile of the log ratio: log2 of a gamma quantile, shape observed + alpha, rate expected + alpha."""

    @F.pandas_udf("double")
    def bound(n: pd.Series, e: pd.Series) -> pd.Series:
        out = np.full(len(n), np.nan)
        ok = (n.notna() & e.notna()).to_numpy()
        if ok.any():
            x = gamma_quantile(q, n[ok].to_numpy(float) + alpha) / (e[ok].to_numpy(float) + alpha)
            out[ok] = np.log2(x)
        return pd.Series(out).where(ok, None)

    return bound(observed.cast("double"), expected.cast("double"))


def bounded(scored: DataFrame, q: float = 0.025, alpha: float = ALPHA) -> DataFrame:
    """``scored`` with omega_lower and omega_add_lower."""
    n = F.col("n_abz")
    return scored.withColumns(
        {
            "omega_lower": log_ratio_bound(n, F.col("expected"), q, alpha),
            "omega_add_lower": log_ratio_bound(n, F.col("additive_expected"), q, alpha),
        }
    )


def jeffreys(successes: Column, trials: Column, level: float = 0.95) -> Column:
    """struct(low, high): Jeffreys interval of a proportion, exactly 0 and 1 at the ends; NULL without trials."""

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        k, n = k.to_numpy(float), n.to_numpy(float)
        ok = n > 0
        low, high = np.full(len(k), np.nan), np.full(len(k), np.nan)
        if ok.any():
            a, b = k[ok] + 0.5, n[ok] - k[ok] + 0.5
            low[ok] = np.where(k[ok] == 0, 0.0, beta_quantile((1 - level) / 2, a, b))
            high[ok] = np.where(k[ok] == n[ok], 1.0, beta_quantile((1 + level) / 2, a, b))
        return pd.DataFrame({"low": low, "high": high})

    return interval(successes.cast("double"), trials.cast("double"))


def poisson_tail(observed: Column, expected: Column) -> Column:
    """P(X >= observed) for a Poisson mean; 1 at 0."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, e: pd.Series) -> pd.Series:
        n, e = n.to_numpy(float), e.to_numpy(float)
        ok = ~np.isnan(n) & ~np.isnan(e)
        out = np.full(len(n), np.nan)
        out[ok] = np.where(n[ok] <= 0, 1.0, gamma_p(np.maximum(n[ok], 1.0), e[ok]))
        return pd.Series(out)

    return tail(observed.cast("double"), expected.cast("double"))
