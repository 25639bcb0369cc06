"""FNV-1a 64-bit hashing of text columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.schemas import CACHE_KEY_PREFIX
from promptmill.session import bound_batches, ship_package

# Fixed values of the FNV-1a 64-bit hash.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
_MASK = (1 << 64) - 1
BATCH_BYTES = "16m"  # of an Arrow batch: wide enough to hash many texts at once
_NARROW = 24  # below this many live rows a plain integer loop beats numpy calls


def _fnv_batch(texts: list[str]) -> list[str]:
    """Hash one Arrow batch: a byte position at a time over all texts still that long."""
    raw = [t.encode("utf-8") for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    lengths = np.array([len(raw[i]) for i in order], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(order) else lengths
    flat = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    state = np.full(len(raw), FNV_OFFSET, dtype=np.uint64)
    prime, pos, live = np.uint64(FNV_PRIME), 0, int((lengths > 0).sum())
    while live > _NARROW:
        stop = int(lengths[live - 1])  # every live text reaches at least this far
        head, at = state[:live], starts[:live]
        for p in range(pos, stop):
            head ^= flat[at + p]
            head *= prime
        pos, live = stop, int((lengths > stop).sum())
    for k in range(live):
        h = int(state[k])
        for b in raw[order[k]][pos:]:
            h = ((h ^ b) * FNV_PRIME) & _MASK
        state[k] = h
    out = [""] * len(raw)
    for k, i in enumerate(order):
        out[i] = f"{int(state[k]):016x}"
    return out


@F.pandas_udf(T.StringType())
def _fnv1a64_hex(texts: pd.Series) -> pd.Series:
    present = texts.notna()
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    if present.any():
        out[present] = _fnv_batch(texts[present].tolist())
    return out


def fnv1a64_hex(text: Column | str) -> Column:
    """16 hex digits of the hash of the UTF-8 bytes; NULL stays NULL."""
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    bound_batches(spark, BATCH_BYTES)  # whole texts, or those of a batch of requests: a batch of rows by its bytes
    return _fnv1a64_hex(text)


def fnv1a64_hex_expr(text: Column) -> Column:
    """The same hash as one JVM expression, for short keys (one array element per byte).

    The state is kept as two 32-bit halves in bigints, because 64-bit products overflow under ANSI mode.
    """
    mask = 0xFFFFFFFF
    data = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), r"(?<=\G..)"), lambda x: x != "")

    def step(acc: Column, pair: Column) -> Column:
        x = acc["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("bigint"))
        low = x * 435  # the prime is 2**40 + 435
        high = acc["hi"] * 435 + x * 256 + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("hi"), low.bitwiseAND(F.lit(mask)).alias("lo"))

    seed = F.struct(F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & mask).cast("bigint").alias("lo"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(data, seed, step, lambda s: F.concat(half(s["hi"]), half(s["lo"])))


def cache_key(text: Column, configured: Column | None = None) -> Column:
    """Prompt cache key of a text; a configured key wins over the derived one."""
    derived = F.concat(F.lit(CACHE_KEY_PREFIX), fnv1a64_hex(text))
    return derived if configured is None else F.coalesce(configured, derived)
