"""Half-precision numbers, which Spark has no type for: as two bytes in files, as floats in tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least number that rounds to infinity, the least normal number and the step of those below it.
OVERFLOW, NORMAL, STEP = 65520.0, 2.0**-14, 2.0**-24


def rounded_half(x: Column) -> Column:
    """The half-precision number nearest to ``x``, of two equally near ones the even one, as a double; null and NaN stay.

    A number's step is 2 ** (its exponent - 10), of numbers below the least normal one 2 ** -24. Where the logarithm of a number
    beside a power of two is off by one, the finer step rounds to the same number.
    """
    d = x.cast("double")
    size = F.abs(d)
    step = F.when(size < NORMAL, F.lit(STEP)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(size)) - 10))
    return F.when(F.isnan(d), d).when(size >= OVERFLOW, F.signum(d) * F.lit(float("inf"))).otherwise(F.rint(d / step) * step)


def half_bits(x: Column) -> Column:
    """The 16 bits of the nearest half-precision number, as an integer from 0 to 65535; a zero's sign is dropped."""
    r = rounded_half(x)
    size = F.abs(r)
    power = F.floor(F.log2(size) + F.lit(1e-6))
    part = size * F.pow(F.lit(2.0), 10 - power) - 1024
    own = F.when(F.isnan(r), F.lit(32256.0)).when(size == float("inf"), F.lit(31744.0)).when(size < NORMAL, size / STEP).otherwise((power + 15) * 1024 + part)
    return (own + F.when(r < 0, F.lit(32768.0)).otherwise(F.lit(0.0))).cast("int")


def half_bytes(x: Column) -> Column:
    """The two bytes of the nearest half-precision number, the lower one first."""
    n = half_bits(x)
    return F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.shiftright(n, 8)), 2, "0")))


def bits_of(two_bytes: Column) -> Column:
    """The 16 bits of a number whose lower byte comes first, as an integer."""
    swapped = F.conv(F.hex(two_bytes), 16, 10).cast("int")
    return swapped % 256 * 256 + F.shiftright(swapped, 8)


def half_value(two_bytes: Column) -> Column:
    """One half-precision number, its lower byte first, as a double, by arithmetic on its bits."""
    n = bits_of(two_bytes)
    sign = F.when(n >= 32768, -1.0).otherwise(1.0)
    power, part = F.floor(n / 1024) % 32, n % 1024
    return (
        F.when((power == 31) & (part > 0), F.lit(float("nan")))
        .when(power == 31, sign * F.lit(float("inf")))
        .when(power == 0, sign * part * F.lit(STEP))
        .otherwise(sign * (1 + part / 1024) * F.pow(F.lit(2.0), power - 15))
    )


def _flat_bytes(numbers: pa.Array) -> np.ndarray:
    """The bytes of an array of equally long binaries, without an object a value."""
    offsets = np.frombuffer(numbers.buffers()[1], np.int32 if pa.types.is_binary(numbers.type) else np.int64)
    at = offsets[numbers.offset : numbers.offset + len(numbers) + 1]
    return np.frombuffer(numbers.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(numbers) else np.array([], np.uint8)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def _decode(frames: pa.Array) -> pa.Array:
    inner = frames.flatten()
    flat = np.frombuffer(_flat_bytes(inner.flatten()).tobytes(), "<f2").astype(np.float32)

    def ends(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.concatenate((lists.is_null().to_numpy(zero_copy_only=False), [False])))

    return pa.ListArray.from_arrays(ends(frames), pa.ListArray.from_arrays(ends(inner), pa.array(flat)))


def decode_half(frames: Column) -> Column:
    """``array<array<binary>>`` of half-precision numbers as ``array<array<float>>``: whole Arrow buffers at a time; no number is null."""
    return _decode(frames)


def encode_half(frames: Column) -> Column:
    """``array<array<float>>`` as ``array<array<binary>>``, two bytes a number, which is how ``half_scan`` finds them in files."""
    return F.transform(frames, lambda f: F.transform(f, half_bytes))


def half_scan(spark: SparkSession, path: str, features: Sequence[str], others: str) -> DataFrame:
    """Features kept as half-precision numbers, decoded to ``array<array<float>>``.

    Under a stated schema the two bytes of each number arrive as binary. ``others`` are the remaining columns as DDL.
    """
    ddl = ", ".join([others, *[f"{c} array<array<binary>>" for c in features]])
    df = spark.read.schema(ddl).parquet(path)
    return df.withColumns({c: decode_half(F.col(c)) for c in features})
