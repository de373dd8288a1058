"""Key columns on their way through pandas, which has no integers with nulls: they travel as text and come back exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Carried:
    """cols to select, their schema within pandas, and the expressions that restore them."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        kinds = dict(df.dtypes)
        self.keys = list(keys)
        self.cols: list[Column] = [F.col(f"`{k}`").cast("string").alias(k) if kinds[k] in _WHOLE else F.col(f"`{k}`") for k in keys]
        self.schema = ", ".join(f"`{k}` {'string' if kinds[k] in _WHOLE else kinds[k]}" for k in keys)
        self.back: list[Column] = [F.col(f"`{k}`").cast(kinds[k]).alias(k) if kinds[k] in _WHOLE else F.col(f"`{k}`") for k in keys]
