"""Checks and small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame, cols: list[str]) -> list[str]:
    """``cols``, all of them numeric; TypeError names the first that is not."""
    kinds = dict((f.name, f.dataType) for f in df.schema)
    for c in cols:
        if c not in kinds:
            raise ValueError(f"no column {c!r}")
        if not isinstance(kinds[c], T.NumericType):
            raise TypeError(f"column {c!r} must be numeric, not {kinds[c].simpleString()}")
    return cols


def columns_of_type(df: DataFrame, *kinds: type) -> list[str]:
    """Names of the columns of these types, such as ``NumericType`` or ``StringType``."""
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing values are nulls here; NaN becomes null."""
    floats = columns_of_type(df, T.DoubleType, T.FloatType)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats if cols is None or c in cols})


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def row(df: DataFrame) -> dict:
    """The one row of a reduced frame."""
    return df.first().asDict()


def one_row(df: DataFrame, values: dict) -> DataFrame:
    """A frame of one row made of plain values (float, int, bool, str)."""
    kinds = {float: "double", int: "long", bool: "boolean", str: "string"}
    lits = [F.lit(None if v is None else v).cast(kinds.get(type(v), "double")).alias(k) for k, v in values.items()]
    return df.sparkSession.range(1).select(*lits)
