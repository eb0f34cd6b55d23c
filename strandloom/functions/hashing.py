"""FNV-64a of byte strings, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


#: Values up to this length advance together; longer ones are hashed one by one, this many bytes at a time.
_SHORT, _PIECE = 64, 1 << 20


def _together(values: list[bytes]) -> np.ndarray:
    """All values advance together, byte by byte; the longest ones are last to end."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values[k] for k in order), np.uint8)
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    state = np.full(len(values), _BASIS)
    at = 0
    while n := int(np.searchsorted(-sizes, -at, side="left")):
        state[:n] = (state[:n] ^ data[starts[:n] + at]) * _PRIME
        at += 1
    out = np.empty_like(state)
    out[order] = state
    return out


def _alone(value: bytes) -> np.uint64:
    """A long value without a loop over its bytes.

    A step is h -> (h ^ b) * p, and h ^ b is h + d, where d depends on h's low byte
    alone. The low bytes follow from the lowest bit up: bit k of the product is that of
    the factor, flipped by what the bits below it carry, so that bit k of all states is a
    running exclusive or. With all d known, the last state is a sum of powers of p.
    """
    state = _BASIS
    for at in range(0, len(value), _PIECE):
        data = np.frombuffer(value, np.uint8, min(_PIECE, len(value) - at), at)
        low = np.zeros(len(data), np.uint8)
        first = int(state) & 255
        for k in range(8):
            below = (low ^ data) & np.uint8((1 << k) - 1)
            carry = (below * np.uint8(0xB3)) >> np.uint8(k) & np.uint8(1)
            flips = (data >> np.uint8(k)) & np.uint8(1) ^ carry
            bit = np.empty(len(data), np.uint8)
            bit[0] = first >> k & 1
            bit[1:] = bit[0] ^ np.bitwise_xor.accumulate(flips[:-1])
            low |= bit << np.uint8(k)
        change = (low ^ data).astype(np.int64) - low
        powers = np.multiply.accumulate(np.full(len(data), _PRIME))
        state = state * powers[-1] + (change.astype(np.uint64) * powers[::-1]).sum(dtype=np.uint64)
    return state


def fnv64(values: list[bytes]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    short = [k for k, v in enumerate(values) if len(v) <= _SHORT]
    out[short] = _together([values[k] for k in short])
    with np.errstate(over="ignore"):
        for k, v in enumerate(values):
            if len(v) > _SHORT:
                out[k] = _alone(v)
    return out


@F.arrow_udf(T.LongType())
def fnv64a(values: pa.Array) -> pa.Array:
    """The 64 bits as a signed long; null for null."""
    found = [v for v in values.to_pylist() if v is not None]
    hashes = iter(fnv64([v if isinstance(v, bytes) else v.encode() for v in found]).view(np.int64).tolist())
    return pa.array([None if v is None else next(hashes) for v in values.to_pylist()], pa.int64())


def hex64(value: Column | str) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
