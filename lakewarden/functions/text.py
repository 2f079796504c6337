"""Expressions over texts and values: normal form, masks, evidence, entropy, placeholders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters without width that are dropped before a scan.
ZERO_WIDTH = "​‌‍﻿­⁠᠎"
MASK, MASK_LEAST, MASK_MOST = "X", 4, 32


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def normalized(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text in NFC without zero-width characters.

    Spark has no normal forms of its own. Characters below U+0300 are their
    own composed form, so only rows that hold others send their text to
    Python; for the rest that is a null.
    """
    plain = ~F.coalesce(F.col(text).rlike(r"[^\u0000-\u02ff]"), F.lit(False))
    composed = _composed(F.when(~plain, F.col(text)))
    return docs.withColumn(out, F.translate(F.when(plain, F.col(text)).otherwise(composed), ZERO_WIDTH, ""))


def mask_of(width: Column) -> Column:
    """A run of the mask character as wide as what it hides, within bounds."""
    return F.repeat(F.lit(MASK), F.least(F.lit(MASK_MOST), F.greatest(F.lit(MASK_LEAST), width)))


def evidence(value: Column, secret: Column) -> Column:
    """What a log may show of a value: nothing of secrets, first and last character and length of others."""
    bare = F.regexp_replace(value, r"[\s   -     　﻿]", "")
    shown = F.concat(F.substring(bare, 1, 1), F.lit("••••"), F.right(bare, F.lit(1)), F.lit(" ("), F.length(bare), F.lit(")"))
    return F.when(secret, "••••••").when(F.length(bare) <= 4, "••••").otherwise(shown)


def entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits."""
    size = F.length(value)
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / size
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def diversity(value: Column) -> Column:
    """How many of lower case, upper case, digits and others a value has."""
    kinds = ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")
    return sum((value.rlike(k).cast("int") for k in kinds[1:]), value.rlike(kinds[0]).cast("int"))


#: Forms of values that stand for others, by what they are.
PLACEHOLDERS = (
    ("template marker", r"^(<[^>]+>|\$\{[^}]*\}|\{\{[^}]*\}\}|%[A-Za-z0-9_]+%|__[A-Za-z0-9_]+__|@[A-Za-z0-9_]+@)\z"),
    ("variable", r"^\$[A-Za-z_][A-Za-z0-9_]*\z"),
    ("look-up in the environment", r"^(process\.env|os\.environ|System\.getenv)(?![A-Za-z0-9_])"),
    ("one character repeated", r"^([^\n\r\u2028\u2029])\1+\z"),
    ("keyboard or sequence", r"(?i)^(?:0123456789|abcdefgh|qwerty)"),
    ("filler", r"(?i)^(?:x{4,}|\*{4,}|\.{4,}|-{4,}|_{4,}|#{4,}|\?{4,})\z"),
)
#: Words of which a lower-cased value that names itself holds one of each, and values that are names as a whole.
SLOT_WORDS = r"key|token|secret|password|passwd|pwd|credential|apikey|api_key"
HINT_WORDS = r"your|my|the|insert|enter|add|paste|replace|change|example|sample|dummy|test|fake|placeholder|here|xxx|todo"
WHOLE_NAMES = r"^(example|sample|dummy|placeholder|redacted|changeme|change_me|undefined|null|none|true|false)\z"


def synthetic(value: Column) -> Column:
    """Whether a value is a placeholder: a template marker, filler, a name of itself, or too plain to be a secret."""
    s = F.regexp_replace(value, "^[\"']|[\"']\\z", "")
    low = F.lower(s)
    named = (low.rlike(SLOT_WORDS) & low.rlike(HINT_WORDS)) | low.rlike(WHOLE_NAMES)
    plain = F.when(F.length(s) >= 12, ((entropy(s) < 2.6) & (diversity(s) <= 2)) | (s.rlike(r"^[a-z]+\z") & (entropy(s) < 3.4))).otherwise(False)
    out = s == ""
    for _, pattern in PLACEHOLDERS:
        out = out | s.rlike(pattern)
    return out | named | plain
