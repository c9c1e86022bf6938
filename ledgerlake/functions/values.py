"""Value types of the graph model and helpers on addresses, hashes and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 0)

#: Declared type name (upper case) to Spark type.
TYPES: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "INT64": T.LongType(), "INTEGER": T.LongType(), "UINT": T.DecimalType(20, 0),
    "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "ADDRESS": T.StringType(), "TXHASH": T.StringType(), "AMOUNT": AMOUNT,
    "BLOCKNUMBER": T.LongType(), "BYTES": T.BinaryType(), "TIMESTAMP": T.LongType(),
}


def spark_type(name: str) -> T.DataType:
    name = name.upper().replace(" ", "")
    if name.startswith("SET<"):
        return T.ArrayType(spark_type(name[4:-1]))
    if name not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[name]


def hex_of(col: Column, size: int) -> Column:
    """``0x`` and 2 * size lower-case hex digits of a hex string with or without prefix; null if it is none."""
    digits = F.regexp_replace(F.trim(col), "^0[xX]", "")
    return F.when(digits.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.concat(F.lit("0x"), F.lower(digits)))


def address(col: Column) -> Column:
    return hex_of(col, 20)


def tx_hash(col: Column) -> Column:
    return hex_of(col, 32)


def amount(col: Column, radix: int = 10) -> Column:
    """A token amount from digits; null beyond 38 digits or if it is none."""
    if radix == 10:
        return col.try_cast(AMOUNT)
    return F.conv(F.regexp_replace(col, "^0[xX]", ""), radix, 10).try_cast(AMOUNT)


def weight(col: Column) -> Column:
    """An edge's weight: its amount, or 1 without one."""
    return F.coalesce(col.cast("double"), F.lit(1.0))
