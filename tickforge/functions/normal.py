"""The normal distribution: on the driver for scalars, as an Arrow UDF for columns (Spark has no erf)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_N = NormalDist()


def cdf(x: float) -> float:
    return _N.cdf(x)


def quantile(p: float) -> float:
    return _N.inv_cdf(p)


@F.pandas_udf(DoubleType())
def _cdf(x: pd.Series) -> pd.Series:
    from math import erfc

    return pd.Series([None if np.isnan(v) else 0.5 * erfc(-v / 2**0.5) for v in x.to_numpy(float)], dtype="float64")


def cdf_column(x: Column) -> Column:
    return _cdf(x)
