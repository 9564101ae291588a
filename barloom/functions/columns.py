"""Scalar helpers as columns. A number that isn't there is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that stands for no value, in lower case (fixed values).
NO_VALUE = ("", "nan", "none", "null")
#: Date formats of uploads, and what text must look like to be tried: ISO first, so that what was saved is read back as it was; then day first.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$",
}


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    number = c.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def without_nan(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as NULL."""
    return df.selectExpr(*(f"if(isnan(`{n}`), NULL, `{n}`) AS `{n}`" if t in ("double", "float") else f"`{n}`" for n, t in df.dtypes))


def pct(now: Column, then: Column) -> Column:
    """Change in percent; NULL if either is NULL or ``then`` is 0."""
    return (F.try_divide(now, F.when(then != 0, then)) - 1) * 100


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def number_of_text(c: Column) -> Column:
    """``" 1,200 "`` is 1200, ``"5%"`` is 5; words for nothing and other text are NULL."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*NO_VALUE), finite(F.regexp_replace(text, "[,%]", "").try_cast("double")))


def date_of_text(c: Column) -> Column:
    """A timestamp by the first format that fits. A format is tried only on text of its shape, as one that doesn't fit costs an exception in the JVM."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in DATE_FORMATS.items()))


def any_of(items, default: bool = False) -> Column:
    return reduce(lambda a, b: a | b, items, F.lit(default))


def all_of(items) -> Column:
    """AND over conditions, each NULL taken as false; no conditions: false."""
    items = [F.coalesce(i, F.lit(False)) for i in items]
    return reduce(lambda a, b: a & b, items) if items else F.lit(False)
