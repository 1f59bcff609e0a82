"""Scalar helpers that Spark has no function for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK128 = (1 << 128) - 1
# Multiplier and increment of the 128-bit linear congruential generator of the sort benchmark's records.
LCG_A = 0x2360ED051FC65DA44385DF649FCCF645
LCG_C = 0x4A696D47726179524950202020202001
_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def java_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + c over UTF-16 units (a character outside the BMP is two)."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    units = F.filter(F.split(text, ""), lambda c: c != "")
    high = lambda c: F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10)
    low = lambda c: F.lit(0xDC00) + (F.ascii(c) - 0x10000).bitwiseAND(F.lit(0x3FF))
    step = lambda h, c: F.when(F.ascii(c) < 0x10000, wrap(h * 31 + F.ascii(c))).otherwise(wrap(wrap(h * 31 + high(c)) * 31 + low(c)))
    return F.aggregate(units, F.lit(0).cast("long"), step).cast("int")


def parse_size(text: str, record: int = 100) -> int:
    """Records in a size with a suffix k, m, g or t (thousands of bytes and so on)."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([kmgtKMGT]?)b?\s*", text)
    if not found:
        raise ValueError(f"no size: {text!r}")
    return int(found[1]) * _UNITS[found[2].lower()] // record


def format_size(size: int) -> str:
    for unit, scale in reversed(_UNITS.items()):
        if size >= scale and unit:
            return f"{size / scale:.1f}{unit}"
    return str(size)


class Lcg128:
    """x -> a x + c modulo 2**128, with a skip of any number of steps in logarithmic time."""

    def __init__(self, seed: int = 0):
        self.x = seed & MASK128

    def step(self) -> int:
        self.x = (self.x * LCG_A + LCG_C) & MASK128
        return self.x

    def skip(self, n: int) -> Lcg128:
        a, c, scale, shift = LCG_A, LCG_C, 1, 0
        while n:
            if n & 1:
                scale, shift = scale * a & MASK128, (shift * a + c) & MASK128
            a, c = a * a & MASK128, (a * c + c) & MASK128
            n >>= 1
        self.x = (self.x * scale + shift) & MASK128
        return self
