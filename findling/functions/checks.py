"""Checks of identifiers as column expressions: check digits, check sums and the numbers they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of base 58, those of base 32 in addresses, and the five generators of that code's check sum.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: What the check sum leaves, in the first form of the code and in the second.
LEFT_OVER = (1, 0x2BC830A3)
#: Numbers in base 2^24, least part first: nine parts hold the 200 bits of an address and more.
PART_BITS, PARTS = 24, 9


def _characters(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0))


def _place(digits: str, c: Column) -> Column:
    return F.instr(F.lit(digits), c).cast("long") - 1


def luhn(v: Column) -> Column:
    """The digits of ``v``, every second one from the right doubled, sum to a multiple of ten."""
    digits = F.transform(F.regexp_extract_all(F.reverse(v), F.lit("[0-9]"), F.lit(0)), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def octets(v: Column) -> Column:
    """No part between dots is above 255."""
    return F.forall(F.split(v, r"\.", -1), lambda p: p.cast("int") <= 255)


def iban(v: Column) -> Column:
    """The number spelled by ``v``, its first four characters last and letters from 10 on, leaves 1 by 97."""
    turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_characters(turned), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def base58_number(v: Column) -> Column:
    """The parts of a number in base 58: each digit multiplies all parts by 58 and carries over."""

    def times_58(parts: Column, c: Column) -> Column:
        start = F.struct(_place(BASE58, c).alias("carry"), F.array().cast("array<bigint>").alias("parts"))

        def one(state: Column, part: Column) -> Column:
            n = part * 58 + state["carry"]
            return F.struct(F.shiftright(n, PART_BITS).alias("carry"), F.concat(state["parts"], F.array(n.bitwiseAND(F.lit((1 << PART_BITS) - 1)))).alias("parts"))

        return F.aggregate(parts, start, one, lambda s: s["parts"])

    return F.aggregate(_characters(v), F.array_repeat(F.lit(0).cast("bigint"), PARTS), times_58)


def base58_check(v: Column) -> Column:
    """25 bytes in base 58, the last four of which begin the double SHA-256 of the others; a leading 1 for each leading zero byte."""
    digits = F.array_join(F.transform(F.reverse(base58_number(v)), lambda p: F.lpad(F.hex(p), PART_BITS // 4, "0")), "")
    spare = PARTS * PART_BITS // 4 - 50
    held = F.substring(digits, spare + 1, 50)
    payload = F.unhex(F.substring(held, 1, 42))
    total = F.sha2(F.unhex(F.sha2(payload, 256)), 256)
    ones, zeros = F.length(F.regexp_extract(v, "^1*", 0)), F.floor(F.length(F.regexp_extract(held, "^(?:00)*", 0)) / 2)
    return (F.substring(digits, 1, spare) == "0" * spare) & (ones == zeros) & (F.lower(F.substring(held, 43, 8)) == F.substring(total, 1, 8))


def base32_check(v: Column, prefix: str = "bc") -> Column:
    """An address ``prefix`` + 1 + base 32 whose check sum, prefix included, leaves one of ``LEFT_OVER``; in one case throughout."""
    low = F.lower(v)
    data = F.transform(_characters(F.substring(low, len(prefix) + 2, 128)), lambda c: _place(BASE32, c))
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    values = F.concat(F.array(*[F.lit(x).cast("long") for x in head]), data)

    def step(a: Column, x: Column) -> Column:
        top = F.shiftright(a, 25)
        moved = F.shiftleft(a.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(x)
        chosen = [F.when(F.shiftright(top, i).bitwiseAND(F.lit(1)) == 1, F.lit(g).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(GENERATORS)]
        return reduce(lambda p, q: p.bitwiseXOR(q), chosen, moved)

    cased = (v == low) | (v == F.upper(v))
    return cased & F.startswith(low, F.lit(f"{prefix}1")) & F.forall(data, lambda x: x >= 0) & F.aggregate(values, F.lit(1).cast("long"), step).isin(*LEFT_OVER)


def wallet(v: Column) -> Column:
    """An address in base 58 or in base 32."""
    return F.when(F.rlike(v, F.lit("^(?i:bc1)")), base32_check(v)).otherwise(base58_check(v))
