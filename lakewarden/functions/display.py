"""Expressions for what people read: relative times, highlights, labels, escapes and light markup; and fingerprints of turns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.functions import folds

#: Characters of each end of a turn that its fingerprint covers.
ENDS = 100
#: Tools, and pieces of the host names that tell them, in order.
HOSTS = (
    ("ChatGPT", ("openai", "chatgpt")),
    ("Gemini", ("google", "gemini")),
    ("Claude", ("claude", "anthropic")),
    ("Perplexity", ("perplexity",)),
    ("Copilot", ("microsoft", "copilot", "bing")),
)


def fingerprint(text: Column) -> Column:
    """A short hash of a text's ends and length, in base 36 with a sign: a 32-bit number that takes 31 times itself for every character. Null and empty texts have an empty one."""
    size = F.length(text)
    sample = F.concat_ws("|", F.substring(text, 1, ENDS), F.right(text, F.lit(ENDS)), size.cast("string"))
    codes = F.transform(F.filter(F.split(sample, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    number = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    signed = lambda n: F.concat(F.when(n >= 1 << 31, "-").otherwise(""), F.lower(F.conv(F.when(n >= 1 << 31, (1 << 32) - n).otherwise(n).cast("string"), 10, 36)))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "").otherwise(folds.let(number, signed))


def tool_of(host: Column) -> Column:
    """The tool that a host name belongs to."""
    low, out = F.lower(F.coalesce(host, F.lit(""))), F.lit("Unknown AI")
    for tool, pieces in reversed(HOSTS):
        found = F.lit(False)
        for piece in pieces:
            found = found | F.contains(low, F.lit(piece))
        out = F.when(found, tool).otherwise(out)
    return out


def parsed_time(value: Column, as_of: datetime) -> Column:
    """A time from its text in ISO form; what is none counts as the present."""
    return F.coalesce(F.try_to_timestamp(value), F.lit(as_of))


def relative(ts: Column, as_of: datetime, weeks: bool = False) -> Column:
    """How long ago a time was: in minutes, hours and days (and weeks, where these are wanted), else its date. Null has none."""
    minutes = F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    said = F.when(minutes < 1, "just now" if weeks else "Just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago"))).when(days < 7, F.concat(days, F.lit("d ago")))
    if weeks:
        said = said.when(days < 30, F.concat(F.floor(days / 7), F.lit("w ago")))
    return F.when(ts.isNull(), "" if weeks else None).otherwise(said.otherwise(F.date_format(ts, "M/d/yyyy")))


def humanized(label: Column) -> Column:
    """A label with blanks for its underscores, and a capital at the beginning of each word."""
    spaced = F.replace(F.coalesce(label, F.lit("")), F.lit("_"), F.lit(" "))
    words = F.filter(F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0)), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def escaped(text: Column) -> Column:
    """A text as it stands between tags."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def escaped_attribute(text: Column) -> Column:
    """The quotes of a text as they stand in an attribute."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def highlighted(text: Column, query: str, most: int, tag: str = "mark") -> Column:
    """A text, cut to a bound and escaped, with the first occurrence of a query marked, whatever its case."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))
    if len(query) < 2:
        return escaped(cut)

    def marked(t: Column) -> Column:
        at = F.instr(F.lower(t), query.lower())
        parts = F.concat(escaped(F.substring(t, F.lit(1), at - 1)), F.lit(f"<{tag}>"), escaped(F.substring(t, at, F.lit(len(query)))), F.lit(f"</{tag}>"), escaped(F.substring(t, at + len(query), F.length(t))))
        return F.when(at == 0, escaped(t)).otherwise(parts)

    return folds.let(cut, marked)


def markdown(text: Column) -> Column:
    """Fenced and inline code, bold and slanted text as HTML. What stands in a fence is left as it is."""
    fence = r"(?s)```\w*\n?.*?```"
    inline = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "`([^`]+)`", "<code>$1</code>"), r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    body = F.coalesce(text, F.lit(""))
    fences = F.transform(F.regexp_extract_all(body, F.lit(fence), F.lit(0)), lambda f: F.concat(F.lit("<pre><code>"), F.trim(F.regexp_extract(f, r"(?s)```\w*\n?(.*?)```", 1), F.lit(" \n\r\t")), F.lit("</code></pre>")))
    pieces = F.transform(F.split(body, fence, -1), inline)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), fences.alias("f")), lambda x: F.array(x["p"], F.coalesce(x["f"], F.lit(""))))), "")
