"""Canonical forms of the dirty text columns: names, splits, checksums, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name_key(x: Column | str) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one `_`, none at the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), "^_|_$", "")


def split_key(x: Column | str) -> Column:
    """train, val or test whatever the case and outer blanks, `validation` meaning val; anything else is null."""
    s = F.lower(F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", ""))
    # most values are canonical already and skip the pattern
    return F.when(_c(x).isin(*SPLITS), _c(x)).when(s == "validation", "val").when(s.isin(*SPLITS), s)


def md5_key(x: Column | str) -> Column:
    """Lower-case checksum; null and the empty string are null."""
    return F.nullif(F.lower(_c(x)), F.lit(""))


def hash_words(x: Column | str) -> list[Column]:
    """The four signed 64-bit words of a 256-bit hash; null for any other length."""
    h = F.hex(F.when(F.octet_length(_c(x)) == 32, _c(x)))
    return [F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(4)]


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 256-bit hashes; null where either has another length."""
    out = None
    for x, y in zip(hash_words(a), hash_words(b)):
        n = F.bit_count(x.bitwiseXOR(y))
        out = n if out is None else out + n
    return out
