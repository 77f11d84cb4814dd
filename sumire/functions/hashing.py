"""Digests and hash splits, all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, 64 hex digits."""
    return F.sha2(text, 256)


def _keyed(key: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def bucket(key: Column, seed: str, hex_digits: int, modulus: int) -> Column:
    """The first hex digits of sha256("seed:key") as an unsigned number, modulo. Null keys give null."""
    number = F.conv(F.substring(_keyed(key, seed), 1, hex_digits), 16, 10).cast("decimal(20,0)")
    return F.when(key.isNotNull(), (number % modulus).cast("int"))


def wide_bucket(key: Column, seed: str, modulus: int) -> Column:
    """The whole 256-bit digest modulo, folded digit by digit (no type holds 256 bits)."""
    digits = F.split(_keyed(key, seed), "")
    step = lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("int")) % modulus
    return F.when(key.isNotNull(), F.aggregate(digits, F.lit(0), step))


def article_split(key: Column, seed: str) -> Column:
    """train below 90 of 100, validation below 95, else test."""
    b = bucket(key, seed, 16, 100)
    return F.when(b < 90, "train").when(b < 95, "validation").when(b.isNotNull(), "test")


def shuffle_key(key: Column, seed: str) -> Column:
    """A deterministic random order: sort by it."""
    return _keyed(key, seed)


def digest_sample(text: Column, one_in: int) -> Column:
    """About one row in one_in, by the first eight digits of its digest."""
    return (F.conv(F.substring(digest(text), 1, 8), 16, 10).cast("long") % one_in) == 0
