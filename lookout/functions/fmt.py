"""Python-exact fixed-point text for numbers shown in explanations.

Spark's ``format_string`` rounds half-up on the shortest decimal form and
``bround`` rounds that form half-even; Python's ``'%.nf'`` rounds the exact
binary value. Explanation texts must read the same as the reference, so
this one helper formats with Python, Arrow-batched (a pandas UDF over the
per-address table only, never over raw events).
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lookout.functions.text import col


@lru_cache(maxsize=None)
def _fixed_udf(digits: int):
    spec = f"{{:.{digits}f}}"

    @F.pandas_udf("string")
    def fixed_text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else spec.format(float(x)))

    return fixed_text


def py_fixed(c, digits: int) -> Column:
    return _fixed_udf(digits)(col(c).cast("double"))
