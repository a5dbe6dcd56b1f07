"""Currency amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies billed in whole units and in thousandths.
ZERO_DECIMAL = ("bif", "clp", "djf", "gnf", "jpy", "kmf", "krw", "mga", "pyg", "rwf", "ugx", "vnd", "vuv", "xaf",
                "xof", "xpf")
THREE_DECIMAL = ("bhd", "jod", "kwd", "omr", "tnd")


def major(amount: Column, currency: Column) -> Column:
    """F-11: minor units as currency units, exactly."""
    value = F.coalesce(amount, F.lit(0)).cast("decimal(18,3)")
    divisor = (F.when(currency.isin(*ZERO_DECIMAL), 1).when(currency.isin(*THREE_DECIMAL), 1000).otherwise(100))
    return (value / divisor.cast("decimal(5,0)")).cast("decimal(18,3)")


def thousandths(amount: Column) -> Column:
    """F-11: store prices are in thousandths of any currency."""
    return (F.coalesce(amount, F.lit(0)).cast("decimal(18,3)") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(18,3)")
