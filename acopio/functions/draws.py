"""Draws that depend on keys alone: the same in every plan, partition and engine."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2**31 - 1
_FACTORS = (1_000_003, 10_007, 101, 7)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) for up to four whole numbers, by multiplication modulo a prime and mixing of bits."""
    x = sum((k.cast("long") * f for k, f in zip(keys, _FACTORS, strict=False)), F.lit(seed).cast("long")) % _PRIME
    x = x * 48271 % _PRIME
    x = x.bitwiseXOR(F.shiftright(x, 15)) * 69621 % _PRIME
    x = x.bitwiseXOR(F.shiftright(x, 13)) * 40692 % _PRIME
    return (x + 0.5) / 2147483648.0


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number for the keys."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def normals(seed: int, *keys: np.ndarray) -> np.ndarray:
    """normal() of arrays of keys, in tasks; equal to it but for the last bits."""

    def uniforms(seed: int) -> np.ndarray:
        x = np.fmod(sum((np.asarray(k, np.int64) * f for k, f in zip(keys, _FACTORS, strict=False)), np.int64(seed)), _PRIME)
        x = np.fmod(x * 48271, _PRIME)
        for shift, factor in ((15, 69621), (13, 40692)):
            x = np.fmod((x ^ (x >> shift)) * factor, _PRIME)
        return (x + 0.5) / 2147483648.0

    return np.sqrt(-2 * np.log(uniforms(seed))) * np.cos(2 * math.pi * uniforms(seed + 1))


def uniform_sql(seed: int, *keys: str) -> str:
    """uniform() in the SQL of the comparison."""
    x = f"(({seed} + " + " + ".join(f"{k} * {f}" for k, f in zip(keys, _FACTORS, strict=False)) + f") % {_PRIME} * 48271 % {_PRIME})"
    for shift, factor in ((15, 69621), (13, 40692)):
        x = f"(xor({x}, {x} >> {shift}) * {factor} % {_PRIME})"
    return f"(({x} + 0.5) / 2147483648.0::DOUBLE)"


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed, *keys)})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(seed + 1, *keys)}))"
