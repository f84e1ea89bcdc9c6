"""The 32-bit string hash over UTF-16 units, and what is named by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the hash
SEED, FACTOR = 5381, 33


def _units(text: Column) -> Column:
    """UTF-16 units. Texts without characters beyond the first plane need no decoding."""
    plain = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    words = F.hex(F.encode(text, "UTF-16BE"))
    pairs = F.transform(F.split(words, "(?<=\\G[0-9A-F]{4})"), lambda h: F.conv(h, 16, 10).cast("long"))
    wide = F.octet_length(F.encode(text, "UTF-16BE")) > 2 * F.length(text)
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).when(wide, F.filter(pairs, lambda x: x.isNotNull())).otherwise(plain)


def string_hash(text: Column) -> Column:
    """h = h * 33 xor unit, in 32 bits, as a number from 0."""
    return F.aggregate(_units(text), F.lit(SEED).cast("long"), lambda h, x: (h * FACTOR).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(x))


def storage_hash(text: Column) -> Column:
    """For pseudonyms. 32 bits only: see salted_hash()."""
    return F.concat(F.lit("hash_"), F.lower(F.hex(string_hash(text))))


def salted_hash(text: Column, salt: str) -> Column:
    return F.concat(F.lit("hash_"), F.sha2(F.concat(F.lit(salt), text), 256))


def fingerprint(boundary: Column, name: Column, message: Column, stack: Column, severity: Column) -> Column:
    first = F.coalesce(F.substring_index(stack, "\n", 1), F.lit(""))
    return F.concat(F.lit("err_"), F.lower(F.hex(string_hash(F.concat_ws("|", boundary, name, message, first, severity)))))
