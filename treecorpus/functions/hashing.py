"""Hash expressions: stable draws, digests, URL ids."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _blake2b_unit(size: int):
    @F.pandas_udf(T.DoubleType())
    def digest(keys: pd.Series) -> pd.Series:
        scale = 2.0 ** (8 * size)
        return keys.map(
            lambda k: None if k is None
            else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=size).digest(), "big") / scale
        )

    return digest


def _blake2b_hex(size: int):
    @F.pandas_udf(T.StringType())
    def digest(keys: pd.Series) -> pd.Series:
        return keys.map(
            lambda k: None if k is None else hashlib.blake2b(k.encode(), digest_size=size).hexdigest()
        )

    return digest


def md5_fraction(key: Column) -> Column:
    """First 8 hex digits of md5 as a fraction in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit_hash(key: Column, seed: int = 0, mode: str = "md5") -> Column:
    """Stable fraction in [0, 1) for ``seed:key``.

    ``md5`` stays in generated code; ``blake2b`` (8 bytes, big-endian) gives the bit-exact
    published split and costs one Arrow round trip.
    """
    text = F.concat(F.lit(f"{seed}:"), key)
    if mode == "md5":
        return md5_fraction(text)
    if mode == "blake2b":
        return _blake2b_unit(8)(text)
    raise ValueError(f"unknown hash mode {mode!r}")


def text_digest(text: Column, size: int = 8, mode: str = "md5") -> Column:
    """Hex digest of ``size`` bytes."""
    if mode == "md5":
        return F.substring(F.md5(text), 1, 2 * size)
    if mode == "sha256":
        return F.substring(F.sha2(text, 256), 1, 2 * size)
    if mode == "blake2b":
        return _blake2b_hex(size)(text)
    raise ValueError(f"unknown hash mode {mode!r}")


def hash_vector(key: Column, dim: int = 16) -> Column:
    """``dim`` values in [-1, 1]: bytes of sha256(``key:counter``) / 127.5 - 1."""
    blocks = -(-dim // 32)
    hexes = F.concat(*[F.sha2(F.concat(key, F.lit(f":{i}")), 256) for i in range(blocks)])
    # Bound once per row: a lambda would compute the digests for each value.
    return F.element_at(F.transform(F.array(hexes), lambda text: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)), 1)


@F.pandas_udf(T.LongType())
def adler32(text: pd.Series) -> pd.Series:
    """The zlib checksum used as a URL id."""
    return text.map(lambda t: None if t is None else zlib.adler32(t.encode()))
