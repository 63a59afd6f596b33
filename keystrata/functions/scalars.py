"""Scalar functions on keys, values and sizes, all as built-in expressions but for the exact FNV-1a hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The FNV-1a offset basis and prime (32 bits), and the codes of logged operations.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
OP_CODES = {"P": 1, "D": 2}


def op_code(op: Column) -> Column:
    return F.when(op == "P", OP_CODES["P"]).when(op == "D", OP_CODES["D"])


def op_name(code: Column) -> Column:
    return F.when(code == OP_CODES["P"], "P").when(code == OP_CODES["D"], "D")


def _le32(n: Column) -> Column:
    """An integer as 4 little-endian bytes."""
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def record_crc32(op: Column, key: Column, value: Column) -> Column:
    """CRC-32 over op code, length and bytes of the key, length and bytes of the value."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.crc32(F.concat(F.unhex(F.lpad(F.hex(op_code(op)), 2, "0")), _le32(F.length(k)), k, _le32(F.length(v)), v))


def spaced_hex(value: Column) -> Column:
    """Lower-case hexadecimal bytes, separated by spaces."""
    return F.regexp_replace(F.lower(F.hex(value)), "(..)(?!$)", "$1 ")


def lossy_text(value: Column) -> Column:
    """UTF-8 text of a binary value, malformed parts as U+FFFD."""
    return F.call_function("make_valid_utf8", value.cast("string"))


def shown(value: Column) -> Column:
    """Text if the bytes are valid UTF-8, else spaced hexadecimal."""
    return F.when(F.call_function("is_valid_utf8", value.cast("string")), value.cast("string")).otherwise(spaced_hex(value))


def byte_size(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0))


def uptime(seconds: Column) -> Column:
    """Seconds as days, hours, minutes and seconds, from the first that isn't zero, minutes at least."""
    s = seconds.cast("bigint")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda *parts: F.concat_ws(" ", *(F.concat(n.cast("bigint").cast("string"), F.lit(u)) for n, u in parts))
    return F.when(d > 0, text((d, "d"), (h, "h"), (m, "m"), (r, "s"))).when(h > 0, text((h, "h"), (m, "m"), (r, "s"))).otherwise(text((m, "m"), (r, "s")))


def segment_file(segment_id: Column) -> Column:
    return F.concat(F.lpad(segment_id.cast("string"), 6, "0"), F.lit(".parquet"))


def seq_label(seq: Column) -> Column:
    return F.concat(F.lit("seq:"), seq.cast("string"))


def _flat(keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all keys end to end, where each begins, and its length."""
    if isinstance(keys, pa.Array):
        keys = keys.fill_null(b"" if pa.types.is_binary(keys.type) or pa.types.is_large_binary(keys.type) else "").cast(pa.large_binary())
        _, offsets, data = keys.buffers()
        edges = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, np.int64)
        return np.frombuffer(data or b"", np.uint8), edges[:-1], np.diff(edges)
    raw = [b"" if k is None else bytes(k) if not isinstance(k, str) else k.encode() for k in keys]
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


@F.pandas_udf(T.IntegerType())
def _shared_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    (x, at, m), (y, to, n) = _flat(a), _flat(b)
    least, out = np.minimum(m, n), np.zeros(len(m), np.int32)
    live = np.flatnonzero(least > 0)
    i = 0
    while len(live):
        live = live[x[at[live] + i] == y[to[live] + i]]
        i += 1
        out[live] = i
        live = live[least[live] > i]
    return pd.Series(out)


def shared_prefix(a: Column, b: Column) -> Column:
    """Leading bytes that two keys have in common; 0 if either is null."""
    return _shared_prefix(a.cast("binary"), b.cast("binary"))


def _fnv1a(keys: pd.Series, basis: int) -> np.ndarray:
    """Hash of each byte string, all strings a byte at a time."""
    data, start, size = _flat(keys)
    h, least = np.full(len(size), basis, np.uint64), int(size.min(initial=int(size.max(initial=0))))
    for i in range(least):
        h = (h ^ data[start + i]) * np.uint64(FNV_PRIME) & np.uint64(0xFFFFFFFF)
    for i in range(least, int(size.max(initial=0))):
        live = size > i
        h[live] = (h[live] ^ data[start[live] + i]) * np.uint64(FNV_PRIME) & np.uint64(0xFFFFFFFF)
    return h.astype(np.int64)


@F.pandas_udf(T.LongType())
def fnv1a32(keys: pd.Series) -> pd.Series:
    """FNV-1a, 32 bits, of a string or binary column: exact, so Arrow-batched Python."""
    return pd.Series(_fnv1a(keys, FNV_BASIS))
