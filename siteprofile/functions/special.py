"""Functions that neither Spark nor SQL has."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi2_sf(g: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom. For the few rows of a test report."""
    return g.map(lambda x: None if x is None or math.isnan(x) else math.erfc(math.sqrt(max(x, 0.0) / 2)))
