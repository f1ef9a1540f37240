"""Arrow UDFs that return structs from plain Python rows."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def struct_udf(schema: str):
    """Decorator: a function of pandas Series that returns one tuple a row becomes a vectorised UDF of ``struct<schema>``."""

    def wrap(rows):
        def column(*args):
            # the schema is parsed here and not on import, which needs no session
            names = StructType.fromDDL(schema).fieldNames()

            def run(*columns: pd.Series) -> pd.DataFrame:
                got = rows(*[c.astype(object).where(c.notna(), None) for c in columns])
                return pd.DataFrame({n: pd.Series([r[i] for r in got], dtype=object) for i, n in enumerate(names)})

            return F.pandas_udf(_typed(run, len(args)), schema)(*args)

        return column

    return wrap


def _typed(run, n: int):
    """``run`` with n annotated parameters, which is how pandas_udf learns that it is scalar."""
    if n == 1:
        def scalar(a: pd.Series) -> pd.DataFrame:
            return run(a)
    elif n == 2:
        def scalar(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return run(a, b)
    else:
        def scalar(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
            return run(a, b, c)
    return scalar


cloudpickle.register_pickle_by_value(sys.modules[__name__])
