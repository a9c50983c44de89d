"""What counts as "no data", and the projections that turn it into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that mean "no data", compared trimmed and in lower case.
MISSING_TEXTS = ("", "-", "--", "n/a", "null", "none", "nan", "nil", "s/d", "#n/a", "undefined")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_TEXTS)


def clean(c: Column) -> Column:
    """The text, or NULL when it only says that there is none."""
    return F.when(~is_missing(c), c)


def _clean_value(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return clean(c)
    if isinstance(dtype, T.StructType):
        leaves = [_clean_value(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        if not leaves:
            return F.lit(None).cast(dtype)
        # A struct left with nothing inside is dropped as well.
        filled = None
        for leaf in leaves:
            filled = leaf.isNotNull() if filled is None else filled | leaf.isNotNull()
        return F.when(c.isNotNull() & filled, F.struct(*leaves))
    return c


def clean_frame(df: DataFrame) -> DataFrame:
    """Every text leaf of every column cleaned, through nested structs."""
    return df.select([_clean_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def zero_if_missing(df: DataFrame, *measures: str) -> DataFrame:
    """Measures that must always be present: NULL becomes 0."""
    return df.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})
