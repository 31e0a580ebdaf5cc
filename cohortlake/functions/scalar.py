"""Column functions: labels, links, lattices and special functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = float(2**53 - 1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def label(x: Column, kind: str, strict: bool = True) -> Column:
    """Canonical text of a value: booleans in capitals, whole doubles without a fraction; other doubles raise, or are null if not ``strict``."""
    if kind == "boolean":
        return F.upper(x.cast("string"))
    if kind in ("double", "float"):
        whole = finite(x) & (x == F.floor(x)) & (F.abs(x) <= EXACT)
        bad = F.raise_error("a label must be a whole number").cast("string") if strict else F.lit(None).cast("string")
        return F.when(x.isNull(), None).when(whole, x.cast("long").cast("string")).otherwise(bad)
    return x.cast("string")


def length_prefixed(x: Column) -> Column:
    """An injective label: R, the bytes, a colon, the text."""
    return F.concat(F.lit("R"), F.octet_length(x).cast("string"), F.lit(":"), x)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary or string column under a constant key, in lower-case hex; null for null."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def pseudonym(x: Column, key: str, study: str) -> Column:
    """Keyed, study-bound pseudonym of an identifier: an HMAC over length-prefixed parts; null for null."""
    return hmac_sha256(F.concat(length_prefixed(F.lit(study)), length_prefixed(x.cast("string"))), key.encode())


def base64url(x: Column) -> Column:
    """Base64 for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(x), "+/\n\r", "-_"), F.lit("="))


def pack_bits(bits: Column) -> Column:
    """An array of 0 and 1 as binary, the first in the lowest bit of the first byte."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(bits) / 8).cast("int") - 1))
    octet = F.transform(at, lambda b: F.aggregate(F.slice(bits, b * 8 + 1, 8), F.struct(F.lit(0).alias("v"), F.lit(1).alias("w")), lambda acc, x: F.struct((acc.v + x.cast("int") * acc.w).alias("v"), (acc.w * 2).alias("w")), lambda acc: acc.v))
    return F.when(F.size(bits) == 0, F.lit(bytearray())).otherwise(F.unhex(F.array_join(F.transform(octet, lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def one_minus(x: Column) -> Column:
    return F.lit(1.0) - x


def rescaled(x: Column, divisor: int) -> Column:
    """A whole number over a positive divisor, rounded down, also below zero."""
    return F.floor(x / F.lit(divisor)).cast("long") if divisor & (divisor - 1) else F.shiftright(x.cast("long"), divisor.bit_length() - 1)


def linear(xs: list[Column], beta: list[float], intercept: float = 0.0, offset: Column | None = None) -> Column:
    """Linear predictor, summed from left to right."""
    eta = F.lit(float(intercept))
    for x, b in zip(xs, beta, strict=True):
        eta = eta + F.lit(float(b)) * x
    return eta if offset is None else eta + offset


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def exp_clipped(x: Column, lo: float = -3.0, hi: float = 8.0) -> Column:
    return F.exp(clip(x, lo, hi))


def exp_extended(x: Column) -> Column:
    """exp over its whole range, not clipped."""
    return F.exp(x)


def reciprocal(x: Column, lo: float = 0.01, hi: float = 500.0) -> Column:
    return 1 / clip(x, lo, hi)


def log_clipped(x: Column, lo: float = 0.01, hi: float = 100.0) -> Column:
    return F.ln(clip(x, lo, hi))


def log_shift(x: Column) -> Column:
    """Logarithm on [1, 10]."""
    return log_clipped(x, 1.0, 10.0)


def log_shift_wide(x: Column) -> Column:
    """Logarithm on [0.1, 1000]."""
    return log_clipped(x, 0.1, 1000.0)


def lattice(x: Column, scale: int) -> Column:
    """Nearest lattice point, ties to even."""
    return F.rint(x * F.lit(float(scale))).cast("long")


def bin_right_closed(x: Column, grid: list[float]) -> Column:
    """1 plus the number of grid points below x."""
    below = F.lit(1)
    for g in grid:
        below = below + F.when(x > F.lit(float(g)), 1).otherwise(0)
    return below


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: six steps of the recurrence, then the asymptotic series."""
    y, shift = x + 6, F.lit(0.0)
    for k in range(6):
        shift = shift - 1 / (x + k)
    i = 1 / (y * y)
    tail = i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (5 / 660 - i * 691 / 32760)))))
    return shift + F.ln(y) - 0.5 / y - tail


def trigamma(x: Column) -> Column:
    """psi'(x) for x > 0."""
    y, shift = x + 6, F.lit(0.0)
    for k in range(6):
        shift = shift + 1 / ((x + k) * (x + k))
    i = 1 / (y * y)
    tail = (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66)))) * i / y
    return shift + 1 / y + 0.5 * i + tail
