"""Exact quantiles by radix selection, without one task that holds all values.

A double's bits, with the sign turned, order like the double itself, so the value at
a rank is found digit by digit: six passes of 11 bits whatever the values.  A pass
counts the next digit of the values that share a wanted prefix (partial
aggregates, at most 2,048 digits a prefix) and picks the digits inside Spark; one row
per (column, rank) reaches the driver.  All columns and ranks share each pass.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = (11, 11, 11, 11, 11, 9)  # widths of the digits, highest first


def ordered_bits(x: Column) -> Column:
    """The double's bits as a long whose unsigned order is the doubles' order."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")  # + 0: no negative zero
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))


def _double(ordered: int) -> float:
    bits = ordered ^ (1 << 63) if ordered >> 63 else ~ordered & (1 << 64) - 1
    return struct.unpack(">d", struct.pack(">Q", bits))[0]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the non-NULL values of each column, as
    SQL's ``percentile_cont`` has them; None for a column without values."""
    names = list(dict.fromkeys(cols))
    spark = df.sparkSession
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)]))
                     .alias("x")).select("x.c", "x.v").where("v is not null").select("c", ordered_bits(F.col("v")).alias("u"))
    count = df.select(*[F.count(c).alias(str(i)) for i, c in enumerate(names)]).first()
    place = {(i, p): (count[i] - 1) * p for i in range(len(names)) for p in probs if count[i]}
    ranks = sorted({(c, k) for (c, _), h in place.items() for k in (math.floor(h), math.ceil(h))})
    # (column, rank): the digits found so far, and the rank among the values that have them
    found = {(c, k): (0, k) for c, k in ranks}
    left = 64
    for width in BITS if ranks else ():
        state = spark.createDataFrame([(c, k, d, r) for (c, k), (d, r) in found.items()], "c int, k long, prefix long, r long")
        prefix = F.lit(0).cast("long") if left == 64 else F.shiftrightunsigned("u", left)
        digit = F.shiftrightunsigned("u", left - width).bitwiseAND(F.lit((1 << width) - 1))
        wanted = F.broadcast(state.select("c", "prefix").distinct())
        counts = long.select("c", prefix.alias("prefix"), digit.alias("digit")).join(wanted, ["c", "prefix"]).groupBy("c", "prefix", "digit").agg(
            F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "prefix").orderBy("digit")))
        hit = upto.join(F.broadcast(state), ["c", "prefix"]).where("r < upto and r >= upto - n")
        for row in hit.select("c", "k", "prefix", "digit", (F.col("r") - F.col("upto") + F.col("n")).alias("r")).collect():
            found[(row.c, row.k)] = (row.prefix << width | row.digit, row.r)
        if left - width == 0:
            break
        left -= width
    known = {key: _double(d & (1 << 64) - 1) for key, (d, _) in found.items()}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        vals: list[float | None] = []
        for p in probs:
            if not count[i]:
                vals.append(None)
                continue
            h = place[(i, p)]
            a, b = known[(i, math.floor(h))], known[(i, math.ceil(h))]
            vals.append(a + (b - a) * (h - math.floor(h)))
        out[c] = vals
    return out
