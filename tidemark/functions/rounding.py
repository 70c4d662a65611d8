from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 3) -> Column:
    """Rounding as numerical libraries do it: scale, round half to even, scale back."""
    return F.rint(x * 10**digits) / 10**digits


def half_up(x: Column, digits: int = 4) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits
