"""Correct decimal rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidence_engine.functions.text import let

# Splits a double into two halves of at most 26 bits (Dekker 1971).
_SPLITTER = 134217729.0


def round_exact(value: Column, decimals: int) -> Column:
    """Round the *binary* value half to even, as Python's ``round`` does.

    ``round`` and ``bround`` work on the shortest decimal form of a double, so 2.675 (whose
    binary value lies below the tie) goes up with them. Here the scaled value is carried
    as a product plus its exact error, so that a tie is recognised only if it is one.
    Valid while ``abs(value) * 10**decimals`` is below 2**52.
    """
    scale = float(10**decimals)

    def scaled(x: Column) -> Column:
        high = x * _SPLITTER - (x * _SPLITTER - x)
        product = x * scale
        error = (high * scale - product) + (x - high) * scale
        return F.struct(F.floor(product).cast("double").alias("whole"), product.alias("product"), error.alias("error"))

    def rounded(part: Column) -> Column:
        distance = (part["product"] - part["whole"] - 0.5) + part["error"]
        up = (distance > 0) | ((distance == 0) & (part["whole"] % 2 != 0))
        return (part["whole"] + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(value.cast("double"), lambda x: F.when(x.isNotNull(), let(scaled(x), rounded)))
