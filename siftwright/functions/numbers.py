"""Reading numbers from columns of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def tolerant(df: DataFrame, name: str) -> Column:
    """The column as double; NULL for text that is no decimal number and for NaN.

    A cast alone would also take Java forms such as "12d" or "0x1p3", and keep the text "NaN" as a value.
    """
    return tolerant_as(F.col(f"`{name}`"), df.schema[name].dataType)


def tolerant_as(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.trim(value)
        value = F.when(text.rlike(_NUMBER) | F.lower(text).isin(*_INFINITE), text)
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)
