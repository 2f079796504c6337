"""SQL functions of a session: validators, measures of values, signatures, and the text inside of files.

:func:`register` gives a session temporary functions whose bodies are SQL, so
``SELECT iban(x)`` is expanded into the plan that calls it and runs without
Python; nulls give null. ``segments`` alone is a table function in Python, as
no built-in expression opens a container.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions.validators import verhoeff_tables


def _letters(value: str) -> str:
    return f"filter(split({value}, ''), c -> c <> '')"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _digit(value: str, k: int) -> str:
    return f"(ascii(substring({value}, {k + 1}, 1)) - 48)"


def _weighted(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_digit(value, k)}" for k, w in enumerate(weights)) + ")"


def _grid(rows: list[list[int]]) -> str:
    return "array(" + ", ".join(f"array({', '.join(map(str, r))})" for r in rows) + ")"


def _when(shape: str, check: str) -> str:
    """A check of values that have a shape; others are not valid."""
    return f"CASE WHEN v IS NULL THEN NULL WHEN {shape} THEN {check} ELSE false END"


def _verhoeff() -> str:
    products, powers = map(_grid, verhoeff_tables())
    d = _digits("v")
    return f"aggregate(transform({_letters(f'reverse({d})')}, (c, i) -> struct(i % 8 AS r, ascii(c) - 48 AS d)), 0, (a, p) -> get(get({products}, a), get(get({powers}, p.r), p.d))) = 0"


def _luhn(value: str) -> str:
    return f"luhn_check({value})"


_LONG = "upper(v)"
_CUSIP = f"aggregate(transform({_letters('substring(upper(v), 1, 8)')}, (c, i) -> (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c = '*' THEN 36 WHEN c = '@' THEN 37 WHEN c = '#' THEN 38 ELSE ascii(c) - 55 END) * (1 + i % 2)), 0, (a, x) -> a + CAST(floor(x / 10) AS INT) + x % 10)"
_VIN = "translate(upper(v), 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')"
_VIN_SUM = _weighted(_VIN, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])
_CPF = [_weighted(_digits("v"), list(range(n, 1, -1))) for n in (10, 11)]
_AADHAAR = _when(f"length({_digits('v')}) = 12 AND substring({_digits('v')}, 1, 1) > '1'", _verhoeff())

#: Validators by their SQL name: whether a value v is valid.
VALIDATORS = {
    "aadhaar": _AADHAAR,
    "luhn": _when(f"length({_digits('v')}) BETWEEN 12 AND 19", _luhn(_digits("v"))),
    "iban": _when("upper(regexp_replace(v, '[ \\t\\n\\r-]', '')) RLIKE '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$'", f"aggregate({_letters('''concat(substring(upper(regexp_replace(v, '[ \\t\\n\\r-]', '')), 5, 64), substring(upper(regexp_replace(v, '[ \\t\\n\\r-]', '')), 1, 4))''')}, 0, (a, c) -> (CASE WHEN c <= '9' THEN a * 10 + ascii(c) - 48 ELSE a * 100 + ascii(c) - 55 END) % 97) = 1"),
    "library_luhn": _when(f"length({_digits('v')}) >= 8", _luhn(_digits("v"))),
    "library_vin": _when("upper(v) RLIKE '^[A-HJ-NPR-Z0-9]{17}$'", f"substring(upper(v), 9, 1) = CASE WHEN {_VIN_SUM} % 11 = 10 THEN 'X' ELSE CAST({_VIN_SUM} % 11 AS STRING) END"),
    "library_isin": _when("upper(v) RLIKE '^[A-Z]{2}[A-Z0-9]{9}[0-9]$'", _luhn(f"array_join(transform({_letters(_LONG)}, c -> CASE WHEN c <= '9' THEN c ELSE CAST(ascii(c) - 55 AS STRING) END), '')")),
    "library_cusip": _when("upper(v) RLIKE '^[0-9A-Z*@#]{9}$'", f"(10 - {_CUSIP} % 10) % 10 = {_digit('v', 8)}"),
    "library_cpf": _when(f"length({_digits('v')}) = 11 AND NOT {_digits('v')} RLIKE '^([0-9])\\\\1{{10}}$'", f"{_CPF[0]} * 10 % 11 % 10 = {_digit(_digits('v'), 9)} AND {_CPF[1]} * 10 % 11 % 10 = {_digit(_digits('v'), 10)}"),
    "library_dni": _when("upper(v) RLIKE '^[0-9]{8}[TRWAGMYFPDXBNJZSQVHLCKE]$'", "substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(substring(v, 1, 8) AS INT) % 23 + 1, 1) = substring(upper(v), 9, 1)"),
    "library_imo": _when("v RLIKE '[0-9]{7}'", f"{_weighted('''regexp_extract(v, '[0-9]{7}', 0)''', [7, 6, 5, 4, 3, 2])} % 10 = {_digit('''regexp_extract(v, '[0-9]{7}', 0)''', 6)}"),
    "library_dea": _when("upper(v) RLIKE '^[A-Z]{2}[0-9]{7}$'", f"{_weighted('substring(v, 3, 7)', [1, 2, 1, 2, 1, 2])} % 10 = {_digit('substring(v, 3, 7)', 6)}"),
    "library_aadhaar": _AADHAAR,
}

#: Other functions: parameters, type and body.
OTHERS = {
    "mask_for": ("width INT", "STRING", "repeat('X', least(32, greatest(4, width)))"),
    "class_diversity": ("v STRING", "INT", "CAST(v RLIKE '[a-z]' AS INT) + CAST(v RLIKE '[A-Z]' AS INT) + CAST(v RLIKE '[0-9]' AS INT) + CAST(v RLIKE '[^a-zA-Z0-9]' AS INT)"),
    "shannon_bits": ("v STRING", "DOUBLE", f"aggregate(array_distinct({_letters('v')}), CAST(0 AS DOUBLE), (a, c) -> a - size(filter({_letters('v')}, x -> x = c)) / length(v) * log2(size(filter({_letters('v')}, x -> x = c)) / length(v)))"),
}


def _padded(key: Column, pad: int) -> Column:
    """A key as a block of 64 bytes, each combined with a byte by exclusive or: a key over 64 bytes counts as its digest."""
    digits = F.rpad(F.hex(F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)), 128, "0")
    byte = lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lpad(F.hex(byte(k).bitwiseXOR(F.lit(pad)).cast("long")), 2, "0")), ""))


def hmac_sha256(key: Column, body: Column) -> Column:
    """The HMAC-SHA-256 (RFC 2104) of a text or bytes, in lower-case hexadecimal; null if either is null."""
    key, body = key.cast("binary"), body.cast("binary")
    inner = F.unhex(F.sha2(F.concat(_padded(key, 0x36), body), 256))
    return F.when(key.isNotNull(), F.sha2(F.concat(_padded(key, 0x5C), inner), 256))


def hmac_of(secret: str, body: Column) -> Column:
    """The same with a key that is known when the plan is made: its blocks are constants."""
    key = secret.encode()
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


_BLOCK = "rpad(hex(CASE WHEN octet_length(key) > 64 THEN unhex(sha2(key, 256)) ELSE CAST(key AS BINARY) END), 128, '0')"


def _xored(pad: int) -> str:
    return f"unhex(array_join(transform(sequence(0, 63), k -> lpad(hex(CAST(CAST(conv(substring({_BLOCK}, k * 2 + 1, 2), 16, 10) AS INT) ^ {pad} AS BIGINT)), 2, '0')), ''))"


OTHERS["hmac_sha256"] = ("key STRING, body STRING", "STRING", f"CASE WHEN key IS NOT NULL THEN sha2(concat({_xored(0x5C)}, unhex(sha2(concat({_xored(0x36)}, CAST(body AS BINARY)), 256))), 256) END")


def register(spark: SparkSession) -> tuple[str, ...]:
    """Makes the functions part of a session, replacing those of the same names; returns their names."""
    from lakewarden.operators import files

    made = {name: ("v STRING", "BOOLEAN", body) for name, body in VALIDATORS.items()} | OTHERS
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("segments", files.Segments)
    return (*made, "segments")
