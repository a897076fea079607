"""Storage quantities such as ``5Gi`` or ``100M``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of a quantity and their factors.
FACTORS = {
    "n": "0.000000001",
    "u": "0.000001",
    "m": "0.001",
    "": "1",
    "k": str(10**3),
    "M": str(10**6),
    "G": str(10**9),
    "T": str(10**12),
    "P": str(10**15),
    "E": str(10**18),
    "Ki": str(2**10),
    "Mi": str(2**20),
    "Gi": str(2**30),
    "Ti": str(2**40),
    "Pi": str(2**50),
    "Ei": str(2**60),
}
QUANTITY = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,4})?)([A-Za-z]{0,2})$"
LARGEST = 2**63 - 1


def quantity_bytes(text: Column) -> Column:
    """A quantity in bytes, rounded up; NULL if the text is no quantity.

    A number may have an exponent or a suffix.  What is beyond 64 bits counts as
    the largest 64-bit number, of either sign.
    """
    factors = F.create_map(*[F.lit(part) for name, value in FACTORS.items() for part in (name, value)])
    number = F.regexp_extract(text, QUANTITY, 1)
    factor = F.element_at(factors, F.regexp_extract(text, QUANTITY, 2)).cast("decimal(28,9)")
    exact = F.ceil(F.try_multiply(number.try_cast("decimal(28,9)"), factor)).try_cast("bigint")
    beyond = F.when(number.startswith("-"), -LARGEST).otherwise(LARGEST)
    known = (number != "") & factor.isNotNull() & ~((F.regexp_extract(text, QUANTITY, 2) != "") & number.rlike("[eE]"))
    return F.when(known, F.coalesce(exact, beyond))


def size_change(old: Column, new: Column) -> Column:
    """-1, 0 or +1; 0 also where a size is absent or zero, as no comparison is possible."""
    known = (F.coalesce(old, F.lit(0)) > 0) & (F.coalesce(new, F.lit(0)) > 0)
    return F.when(known & (new > old), 1).when(known & (new < old), -1).otherwise(0)
