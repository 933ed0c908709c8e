"""Scalar, array and codec functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def encode_vector(v: Column) -> Column:
    """A vector as ``[v1,v2,...]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def decode_vector(text: Column) -> Column:
    """Back from ``[v1,v2,...]``; items that are no number are skipped."""
    items = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ",")
    return F.filter(F.transform(items, lambda x: F.trim(x).try_cast("float")), lambda x: x.isNotNull())


def overlay(base: DataFrame, over: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys and content: ``right`` of ``over`` where there is one, else ``left`` of ``base``."""
    return base.join(over, keys, "full").select(*keys, F.coalesce(right, left).alias("content"))


def backoff(attempt: Column, initial: float, most: float, jitter: Column) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt), F.lit(most)) * (1 + jitter)


def finite_clamp(x: Column) -> Column:
    """Finite values into [0, 1]; others pass, to be rejected later."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def within(name: str, low: int, high: int) -> Column:
    return F.octet_length(name).between(low, high)


def private_address(host: Column) -> Column:
    """Whether a dotted address is private, loopback, link-local, shared, multicast or reserved."""
    part = lambda i: F.split(host, r"\.")[i].try_cast("int")
    a, b = part(0), part(1)
    inside = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.coalesce(inside, F.lower(host) == "localhost")


def sse_data(wire: Column) -> Column:
    """The payloads of data lines of an event stream's text."""
    lines = F.transform(F.split(wire, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.substring(x, F.lit(7), F.length(x)))


def truncate_bytes(text: Column, size: int) -> Column:
    """The longest prefix of whole characters that has at most ``size`` UTF-8 bytes."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, size + 1)
    head = F.substring(text, 1, size)  # no character is shorter than a byte
    kept = F.aggregate(F.split(head, ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda s, c: F.when(s["b"] + F.octet_length(c) <= size, F.struct((s["n"] + 1).alias("n"), (s["b"] + F.octet_length(c)).alias("b"))).otherwise(F.struct(s["n"].alias("n"), F.lit(size + 1).alias("b"))), lambda s: s["n"])
    return F.when(F.length(raw) <= size, text).otherwise(F.substring(text, F.lit(1), kept))
