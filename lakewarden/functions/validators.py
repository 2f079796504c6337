"""Check digits and shapes of identifiers, as Spark expressions that give true or false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _each(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _digit(value: Column, k: int) -> Column:
    """The digit at place k, from 0, as a number (of a string that has one there)."""
    return F.ascii(F.substring(value, k + 1, 1)) - 48


def _weighted(value: Column, weights: list[int]) -> Column:
    total = _digit(value, 0) * weights[0]
    for k, w in enumerate(weights[1:], 1):
        total = total + _digit(value, k) * w
    return total


def _numbers(values: list[list[int]]) -> Column:
    return F.array(*(F.array(*map(F.lit, row)) for row in values))


def verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """Products in the dihedral group of the pentagon, and the powers of a permutation."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 + (0 if b < 5 else 5) if b < 5 else (a + b - 5) % 5 + 5
        return (a - b) % 5 + 5 if b < 5 else (a - b) % 5

    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([first[k] for k in powers[-1]])
    return [[product(a, b) for b in range(10)] for a in range(10)], powers


def verhoeff(number: Column) -> Column:
    table, powers = map(_numbers, verhoeff_tables())
    places = F.transform(_each(F.reverse(number)), lambda c, i: F.struct((i % 8).alias("row"), (F.ascii(c) - 48).alias("digit")))
    return F.aggregate(places, F.lit(0), lambda acc, p: F.get(F.get(table, acc), F.get(F.get(powers, p["row"]), p["digit"]))) == 0


def aadhaar(value: Column) -> Column:
    d = digits(value)
    return F.when((F.length(d) == 12) & (F.substring(d, 1, 1) > "1"), verhoeff(d)).otherwise(False)


def luhn(value: Column, least: int = 12, most: int | None = 19) -> Column:
    d = digits(value)
    fits = F.length(d) >= least if most is None else F.length(d).between(least, most)
    return fits & F.call_function("luhn_check", d)


def iban(value: Column) -> Column:
    s = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    rest = F.aggregate(
        _each(turned), F.lit(0),
        lambda acc, c: F.when(c <= "9", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97,
    )
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def vin(value: Column) -> Column:
    """ISO 3779: letters stand for digits 1 to 9 in three rows of the alphabet; place 9 is the remainder by 11."""
    s = F.translate(F.upper(value), "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    total = _weighted(s, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    check = F.when(total == 10, "X").otherwise(total.cast("string"))
    return F.when(F.upper(value).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.substring(F.upper(value), 9, 1) == check).otherwise(False)


def isin(value: Column) -> Column:
    s = F.upper(value)
    wide = F.array_join(F.transform(_each(s), lambda c: F.when(c <= "9", c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.when(s.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), luhn(wide, 8, None)).otherwise(False)


def cusip(value: Column) -> Column:
    s = F.upper(value)
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).when(c == "*", 36).when(c == "@", 37).when(c == "#", 38).otherwise(F.ascii(c) - 55)
    doubled = F.transform(_each(F.substring(s, 1, 8)), lambda c, i: code(c) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda acc, v: acc + F.floor(v / 10).cast("int") + v % 10)
    return F.when(s.rlike("^[0-9A-Z*@#]{9}$"), (10 - total % 10) % 10 == _digit(s, 8)).otherwise(False)


def cpf(value: Column) -> Column:
    d = digits(value)
    first = _weighted(d, list(range(10, 1, -1))) * 10 % 11 % 10
    second = _weighted(d, list(range(11, 1, -1))) * 10 % 11 % 10
    return F.when((F.length(d) == 11) & ~d.rlike(r"^(\d)\1{10}$"), (first == _digit(d, 9)) & (second == _digit(d, 10))).otherwise(False)


def dni(value: Column) -> Column:
    s = F.upper(value)
    letter = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), F.try_to_number(F.substring(s, 1, 8), F.lit("99999999")).cast("int") % 23 + 1, F.lit(1))
    return F.when(s.rlike("^[0-9]{8}[TRWAGMYFPDXBNJZSQVHLCKE]$"), letter == F.substring(s, 9, 1)).otherwise(False)


def imo(value: Column) -> Column:
    d = F.regexp_extract(value, "[0-9]{7}", 0)
    return F.when(F.length(d) == 7, _weighted(d, [7, 6, 5, 4, 3, 2]) % 10 == _digit(d, 6)).otherwise(False)


def dea(value: Column) -> Column:
    d = F.substring(value, 3, 7)
    return F.when(F.upper(value).rlike("^[A-Z]{2}[0-9]{7}$"), _weighted(d, [1, 2, 1, 2, 1, 2]) % 10 == _digit(d, 6)).otherwise(False)


#: Validators by the name that detectors give.
VALIDATORS = {
    "aadhaar": aadhaar,
    "luhn": luhn,
    "iban": iban,
    "library_luhn": lambda v: luhn(v, 8, None),
    "library_vin": vin,
    "library_isin": isin,
    "library_cusip": cusip,
    "library_cpf": cpf,
    "library_dni": dni,
    "library_imo": imo,
    "library_dea": dea,
    "library_aadhaar": aadhaar,
}
