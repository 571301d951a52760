"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def no_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, as a missing value is everywhere in this package."""
    c = F.col(name)
    if is_float(df.schema[name].dataType):
        return F.when(~F.isnan(c), c)
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise every floating column of ``df`` so that missing means null."""
    floats = [f.name for f in df.schema.fields if is_float(f.dataType)]
    return df.withColumns({c: no_nan(df, c) for c in floats}) if floats else df


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) < inf), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is null, not an error, over zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def zero_safe(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 over zero (the rule of the classification metrics)."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible order for rows: hex SHA-256 of the seed and the row's key."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_fraction(hex_hash: Column, start: int = 1) -> Column:
    """Eight hex digits of a hash as a uniform number in [0, 1)."""
    return F.conv(F.substring(hex_hash, start, 8), 16, 10).cast("double") / F.lit(float(2**32))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def unpivot(
    df: DataFrame, ids: list[str], columns: list[str], as_type: str, name="feature", value="value", finite_only: bool = False
) -> DataFrame:
    """Long form (ids, name, value) of ``columns``, all cast to one type, without missing values.

    ``finite_only`` reads infinite numbers as missing too.
    """
    # stack, not unpivot, and the filter on the name spelled out: so the branches of a plan stay alike down to
    # the scan, whatever joins stand above them, and Spark reuses their shuffle
    def known(c: str) -> Column:
        return finite(F.col(c)) if finite_only and is_float(df.schema[c].dataType) else no_nan(df, c)

    pairs = [x for c in columns for x in (F.lit(c), known(c).cast(as_type))]
    long = df.select(*ids, F.stack(F.lit(len(columns)), *pairs).alias(name, value))
    return long.where(F.col(name).isNotNull() & F.col(value).isNotNull())
