"""Scalar column helpers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
MINUTE_US = 60_000_000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value limited to [low, high]; null stays null (greatest and least alone would skip it)."""
    x = x.cast("double")
    return F.when(
        x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
    )


def rnd(x: Column, digits: int = 6) -> Column:
    """Round half up with plain double arithmetic, so any IEEE engine gives the same value."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def flag(condition: Column) -> Column:
    """1.0 when the condition is true, 0.0 when it is false or unknown."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp of either kind."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi = F.radians(lat2 - lat1) / 2
    dlam = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dphi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlam), 2
    )
    return F.lit(12742.0) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a)))


def median_sorted(arr: Column) -> Column:
    """Median of an ascending array (mean of the two middles); null when empty."""
    n = F.size(arr)
    low = F.get(arr, F.floor((n - 1) / 2).cast("int"))
    high = F.get(arr, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def key_pads(key: str) -> tuple[bytearray, bytearray]:
    """Inner and outer HMAC pads of a configured key."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytearray(b ^ 0x36 for b in raw), bytearray(b ^ 0x5C for b in raw)


def hmac_from_pads(message: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 as hex from two pads: two native hashes per row."""
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 as hex with one configured key."""
    inner, outer = key_pads(key)
    return hmac_from_pads(message, F.lit(inner), F.lit(outer))


def lit_map(table: dict[str, str]) -> Column:
    """Literal map column from a dict."""
    flat: list[Column] = []
    for key, value in table.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)
