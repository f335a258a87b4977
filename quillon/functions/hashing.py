"""Deterministic 64-bit hashes as signed longs (two's complement).

Products modulo 2^64 are built from 16-bit limbs: plain multiplication overflows in ANSI mode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier of the integer mixer, FNV-1a offset and prime, the hash of a null.
MIX = 0xFF51AFD7ED558CCD
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
NULL_HASH = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def multiply_mod64(x: Column, by: int) -> Column:
    low = F.lit(0xFFFF)
    m = [F.lit((by >> s) & 0xFFFF) for s in (0, 16, 32, 48)]
    a = [F.shiftrightunsigned(x, s).bitwiseAND(low) for s in (0, 16, 32, 48)]
    carry, out = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        column = carry
        for i in range(k + 1):
            column = column + a[i] * m[k - i]
        out = out.bitwiseOR(F.shiftleft(column.bitwiseAND(low), 16 * k))
        carry = F.shiftrightunsigned(column, 16)
    return out


def mix64(c: Column) -> Column:
    """Hash of an integer-like column (cast bool, date days and micros to long first)."""
    x = c.cast("long")
    return F.coalesce(multiply_mod64(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), MIX), F.lit(signed(NULL_HASH)))


def _bits(values: pd.Series) -> pd.Series:
    import numpy as np

    # a missing double reaches pandas as NaN; float_hash tells nulls apart by isNull
    return pd.Series(values.to_numpy(dtype=np.float64, na_value=np.nan).view(np.int64))


def float_hash(c: Column) -> Column:
    """mix64 of the raw IEEE bits: -0.0 and 0.0 differ. SQL cannot reinterpret bits, hence a pandas UDF."""
    bits = F.pandas_udf(_bits, "long")(F.coalesce(c.cast("double"), F.lit(0.0)))
    return F.when(c.isNull(), F.lit(signed(NULL_HASH))).otherwise(mix64(bits))


def fnv1a64(c: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a string."""
    start = F.lit(signed(FNV_OFFSET))

    def fold(data):
        step = lambda h, i: multiply_mod64(h.bitwiseXOR(F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long")), FNV_PRIME)
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), start, step)

    # a lambda variable holds the bytes, else the text would be encoded anew at each of them
    out = F.when(F.octet_length(c) == 0, start).otherwise(F.element_at(F.transform(F.array(F.encode(c, "UTF-8")), fold), 1))
    return F.when(c.isNull(), F.lit(signed(NULL_HASH))).otherwise(out)


def _fnv(values: pd.Series) -> pd.Series:
    """FNV-1a a byte position at a time over all strings that reach it; the last few long ones byte by byte."""
    import numpy as np

    data = [v.encode() for v in values]
    size = np.array([len(v) for v in data], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size
    h = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    reach, i = len(order), 0
    while True:
        while reach and size[order[reach - 1]] <= i:
            reach -= 1
        if reach < 4:
            break
        own = order[:reach]
        h[own] = (h[own] ^ flat[at[own] + i].astype(np.uint64)) * np.uint64(FNV_PRIME)
        i += 1
    for k in order[:reach]:
        x = int(h[k])
        for b in data[k][i:]:
            x = (x ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        h[k] = x
    return pd.Series(h.view(np.int64))


def fnv1a64_text(c: Column) -> Column:
    """fnv1a64 for long texts, in Arrow batches: the fold of fnv1a64 is interpreted, some dozen steps a byte."""
    return F.when(c.isNull(), F.lit(signed(NULL_HASH))).otherwise(F.pandas_udf(_fnv, "long")(F.coalesce(c, F.lit(""))))


def _fold(lists, mixed: bool):
    """The fold of array_hash over Arrow lists of longs, an element position at a time; elements that are hashed already if mixed."""
    import numpy as np
    import pyarrow as pa

    flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    if not mixed:
        x = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.uint64(NULL_HASH), (x ^ (x >> np.uint64(33))) * np.uint64(MIX))
    at = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    h, own = np.full(len(ends), FNV_OFFSET, dtype=np.uint64), np.flatnonzero(at < ends)
    while len(own):
        h[own] = (h[own] ^ x[at[own]]) * np.uint64(FNV_PRIME)
        at[own] += 1
        own = own[at[own] < ends[own]]
    return pa.array(h.view(np.int64))


def array_hash(c: Column, element=mix64) -> Column:
    """A fold of the elements' hashes by FNV's multiplier, so order counts; a null array is 0.

    In Arrow batches: in a lambda, which isn't compiled, an element's hash is worked out anew for each limb.
    """
    mixed = element is not mix64

    def fold(lists):
        return _fold(lists, mixed)

    values = F.transform(c, element) if mixed else c.cast("array<bigint>")
    out = F.arrow_udf(fold, "long", F.ArrowUDFType.SCALAR)(values)
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(out)


def fallback_hash(c: Column) -> Column:
    """Hash of a type without one of its own (decimals and such), by its text; a null is 0."""
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(fnv1a64(c.cast("string")))
