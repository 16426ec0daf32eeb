"""Random choices as functions of a seed, a name and a key: the same in every run and partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int, name: str, *keys: Column) -> Column:
    """Hexadecimal digits; their order is a random order of the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *(k.cast("string") for k in keys)))


def drawn_hashes(seed: int, name: str, scene: object, keys: list[bytes]) -> np.ndarray:
    """``key_hash`` of a scene's keys (each the rest of them, joined by colons) as 16 bytes, for code that runs on arrays in a task."""
    start = hashlib.md5(f"{seed}:{name}:{scene}:".encode())

    def digest(key: bytes) -> bytes:
        h = start.copy()
        h.update(key)
        return h.digest()

    return np.frombuffer(b"".join(map(digest, keys)), "S16")


def drawn(seed: int, name: str, scene: object, keys: list[bytes]) -> np.ndarray:
    """``uniform`` of the same."""
    first = drawn_hashes(seed, name, scene, keys).view(">u8")[::2]
    return (first >> np.uint64(12)).astype(float) / (1 << 52)


def uniform(seed: int, name: str, *keys: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high)."""
    unit = F.conv(F.substring(key_hash(seed, name, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return unit if (low, high) == (0.0, 1.0) else F.lit(low) + unit * F.lit(high - low)


def normal(seed: int, name: str, *keys: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = uniform(seed, name + "/u", *keys), uniform(seed, name + "/v", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def tidy(value: Column, digits: int = 10) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(value, digits) + F.lit(0.0)
