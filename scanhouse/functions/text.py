"""Column expressions for text: word tokens and hashed term buckets (JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a maximal run of Unicode letters or digits, lower-cased;
# a term's bucket is the first 32 bits of its MD5 (hex) modulo the dimension.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
HASH_HEX_CHARS = 8


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text (empty strings removed)."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def term_bucket(term: Column, dim: int) -> Column:
    """Stable hashed bucket in ``[0, dim)`` for a term (same value in any engine with MD5)."""
    first32 = F.conv(F.substring(F.md5(term), 1, HASH_HEX_CHARS), 16, 10).cast("long")
    return F.pmod(first32, F.lit(int(dim))).cast("int")


def term_buckets(text: Column, dim: int) -> Column:
    """``array<int>``: the bucket of every token, in text order."""
    return F.transform(tokens(text), lambda t: term_bucket(t, dim))
