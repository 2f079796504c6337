"""The form of a detector, and its pattern in Java's dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cache
from re import _parser as parser

#: Classes of data by category (what is not listed is personal data), their short names, severities in their order, and tiers.
CLASS_OF = {
    "GOVERNMENT_IDENTIFIER": "HIGH_RISK_IDENTIFIER",
    "GOVERNMENT_IDENTIFIER_GLOBAL": "HIGH_RISK_IDENTIFIER",
    "DRIVING_IDENTIFIER": "HIGH_RISK_IDENTIFIER",
    "FINANCIAL_IDENTIFIER": "HIGH_RISK_IDENTIFIER",
    "FINANCIAL_IDENTIFIER_GLOBAL": "HIGH_RISK_IDENTIFIER",
    "CREDENTIAL_SECRET": "AUTHENTICATION_SECRET",
    "AUTHENTICATION_SECRET": "AUTHENTICATION_SECRET",
    "HEALTH_DATA": "SPECIAL_HANDLING_DATA",
    "BIOMETRIC_DATA": "SPECIAL_HANDLING_DATA",
    "LOCATION_DATA": "SPECIAL_HANDLING_DATA",
    "BUSINESS_IDENTIFIER": "CONFIDENTIAL",
}
SHORT_NAME = {
    "PERSONAL_DATA": "Personal Data",
    "HIGH_RISK_IDENTIFIER": "High-Risk Identifier",
    "AUTHENTICATION_SECRET": "Authentication Secret",
    "SPECIAL_HANDLING_DATA": "Special-Handling Data",
    "CONFIDENTIAL": "Confidential",
}
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
TIERS = {"p": "precise", "c": "contextual", "x": "candidate"}


@dataclass(frozen=True)
class Detector:
    """A pattern with what is known of its matches.

    ``group`` is the capture group that holds the value (0: the whole match),
    ``literal`` a lower-case string without which the text is not searched,
    ``validator`` a check of the value by name, ``inline`` whether the
    detector has a predicate of its own, ``low`` low confidence.
    """

    id: str
    label: str
    category: str
    severity: str
    pattern: str
    flags: str = ""
    group: int = 0
    validator: str = ""
    inline: bool = False
    literal: str = ""
    secret: bool = False
    low: bool = False
    on: bool = True
    classification: str = ""
    family: str = ""
    tier: str = ""
    sample: str = ""

    @property
    def data_class(self) -> str:
        return self.classification or CLASS_OF.get(self.category, "PERSONAL_DATA")

    @property
    def level(self) -> str:
        return self.tier or ("candidate" if self.low else "precise")

    @property
    def rank(self) -> int:
        return SEVERITY_RANK[self.severity]


def library(*, id: str, label: str, pattern: str, tier: str, family: str, classification: str, severity: str, flags: str = "", group: int = 0, validator: str = "", literal: str = "", sample: str = "") -> Detector:
    """A detector of the library: secrets by class, low confidence and off by tier; its validator goes by a name of its own."""
    found = Detector(id, label, family, severity, pattern, flags, group, "", False, literal.lower(), classification == "AUTHENTICATION_SECRET", tier == "x", tier != "x")
    return replace(found, classification=classification, family=family, tier=TIERS[tier], sample=sample, validator=f"library_{validator}" if validator else "")


_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Patterns whose look-behind has no bound: what it consumes goes before the value, which becomes group 1.
REWRITTEN = {
    "CRED_CONNECTION_STRING_PASSWORD": r"\b[a-z][a-z0-9+.\-]*://[^:/\s@]+:([^\s]+?)(?=@[a-zA-Z0-9.\-]+(?::\d+)?(?:[/\s]|$))",
    "CRED_ENV_VALUE": r"^\s*(?:export\s+)?[A-Z][A-Z0-9_]{2,}=[\"']?([^\s\"']{8,})",
}
_TOKEN = re.compile(r"\\.|\[|\]|&&|\.|\$|[^\\\[\].$&]+|&", re.S)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives at the top level of a pattern."""
    parts, depth, inside, at = [""], 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        step = pattern[at : at + 2] if c == "\\" else c
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
        if c == "|" and not inside and depth == 0:
            parts.append("")
        else:
            parts[-1] += step
        at += len(step)
    return parts


def _starts_word(pattern: str) -> bool:
    """Whether a pattern, which has no alternative at its top level, can only begin with a word's character."""
    if len(_alternatives(pattern)) > 1:
        return False
    while pattern.startswith("(?!"):
        pattern = pattern[_closing(pattern) + 1 :]
    if pattern.startswith("("):
        end = _closing(pattern)
        return not pattern[end + 1 : end + 2] in ("?", "*") and all(_starts_word(a) for a in _alternatives(pattern[pattern.startswith("(?:") * 2 + 1 : end]))
    first = re.match(r"(?:[A-Za-z0-9]|\\[dw]|\[[A-Za-z0-9-]+\])(?![?*]|\{0)", pattern)
    return bool(first)


def _closing(pattern: str) -> int:
    """The place of the bracket that closes the first one."""
    depth, inside, at = 0, False, 0
    while True:
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at
        at += 1


def translated(pattern: str, flags: str) -> str:
    """A pattern of JavaScript's dialect in Java's.

    Word edges and ``\\d`` are those of ASCII, white space has all characters
    that JavaScript counts as such, ``.`` stops at its four line ends, ``$``
    matches at the very end only (before a line's end with flag m), and ``[``
    and ``&&`` inside a class are characters. A word edge at the front, before
    what can only be a word's character, needs just look behind itself.
    """
    switches = "".join(f for f in "ims" if f in flags) + ("u" if "i" in flags and not pattern.isascii() else "")
    return (f"(?{switches})" if switches else "") + "|".join(_forward(_translated(a, flags), "i" in flags) for a in _alternatives(pattern))


_BEHIND = re.compile(r"\(\?<!(\[(?:[^\]\\]|\\.)*\]|\\d)\)(\[(?:[^\]\\]|\\.)*\]|\\d)(?:\{(\d+)\}|(?![{*+?]))")


def _forward(pattern: str, folded: bool) -> str:
    """A pattern that begins with what may not stand before its first character, with that asked behind this character, if it is no small letter: most places are then ruled out by a look at one character."""
    found = _BEHIND.match(pattern)
    if not found or re.search("[A-Za-z]" if folded else "[a-z]", found[2].replace(r"\d", "")):
        return pattern
    before, first, times = found.groups()
    rest = int(times or 1) - 1
    return f"{first}(?<!{before}{first})" + (f"{first}{{{rest}}}" if rest else "") + pattern[found.end() :]


def _translated(pattern: str, flags: str) -> str:
    """A pattern without alternatives at its top level, so that a word edge at either end of it is plain to see."""
    out, inside = [], False
    if pattern.startswith(r"\b") and _starts_word(pattern[2:]):
        out, pattern = ["(?<![A-Za-z0-9_])"], pattern[2:]
    if pattern.endswith(r"\b") and re.search(r"(?:[A-Za-z0-9]|\\[dw]|\[[A-Za-z0-9-]+\])(?:\{\d+(?:,\d*)?\}|\+)?\)?\Z", pattern[:-2]) and "|" not in pattern:
        pattern = pattern[:-2] + "(?![A-Za-z0-9_])"
    for token in _TOKEN.findall(pattern):
        if token == "[" and not inside:
            inside = True
        elif token == "]" and inside:
            inside = False
        elif inside and token in ("[", "&&"):
            token = "".join("\\" + c for c in token)
        elif token == r"\s":
            token = _SPACE if inside else f"[{_SPACE}]"
        elif token == r"\S" and not inside:
            token = f"[^{_SPACE}]"
        elif token == r"\b" and not inside:
            token = _EDGE
        elif token == r"\/":
            token = "/"
        elif not inside and token == ".":
            token = r"[^\n\r\u2028\u2029]"
        elif not inside and token == "$":
            token = r"(?=[\n\r\u2028\u2029]|\z)" if "m" in flags else r"\z"
        out.append(token)
    return "".join(out)


@cache
def java_pattern(detector: Detector) -> tuple[str, int]:
    """The pattern for Spark, and the group that holds the value."""
    if detector.id in REWRITTEN:
        return translated(REWRITTEN[detector.id], detector.flags), 1
    pattern = detector.pattern.removesuffix("[\"']?") if detector.group else detector.pattern  # the value ends the match
    return translated(pattern, detector.flags), detector.group


#: Cheap properties of a text, one of which a text needs for many patterns to match: the pattern of each.
PROPERTIES = {"digit": "[0-9]", "digits": "[0-9]{4}", "number": "[0-9]{6}", "at": "@", "setter": "[:=]", "run": "[A-Za-z0-9_/+=.~-]{16}", "long": "[A-Za-z0-9_/+=.~-]{24}", "octets": "[:-][0-9A-Fa-f]{2}[:-]"}
#: Properties that only texts with another one have: those are asked first.
WITHIN = {"digits": "digit", "number": "digits", "long": "run"}
_HEX = frozenset("0123456789abcdefABCDEF")
_DIGITS, _SETTERS, _RUN = frozenset("0123456789"), frozenset(":="), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+=.~-")


def _characters(op, arg) -> frozenset[str] | None:
    """The characters that an element of a parsed pattern takes, if they are few and listed."""
    if op is parser.LITERAL:
        return frozenset(chr(arg))
    if op is not parser.IN:
        return None
    out: set[str] = set()
    for kind, value in arg:
        if kind is parser.LITERAL:
            out.add(chr(value))
        elif kind is parser.RANGE and value[1] < 128:
            out.update(map(chr, range(value[0], value[1] + 1)))
        elif kind is parser.CATEGORY and value is parser.CATEGORY_DIGIT:
            out |= _DIGITS
        else:
            return None
    return frozenset(out)


def _needed(tree) -> set[str]:
    """The properties that whatever a parsed pattern matches has."""
    out: set[str] = set()
    for op, arg in tree:
        times = 1
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            times, _, inner = arg
            if not times:
                continue
            if times > 1 and _octet(inner):
                out.add("octets")
            if len(inner) > 1 or _characters(*inner[0]) is None:
                out |= _needed(inner)
                continue
            op, arg = inner[0]
        if op is parser.SUBPATTERN:
            out |= _needed(arg[3])
        elif op is parser.BRANCH:
            out |= set.intersection(*(_implied(_needed(b)) for b in arg[1]))
        elif chars := _characters(op, arg):
            out |= {name for name, of in (("digit", _DIGITS), ("at", frozenset("@")), ("setter", _SETTERS)) if chars <= of}
            if times >= 16 and chars <= _RUN:
                out.add("long" if times >= 24 else "run")
            if chars <= _DIGITS and times >= 4:
                out.add("number" if times >= 6 else "digits")
    return out - _implied(out, own=False)


def _implied(names: set[str], own: bool = True) -> set[str]:
    """The properties that others imply, and those themselves."""
    out = set(names) if own else set()
    for name in names:
        while name := WITHIN.get(name, ""):
            out.add(name)
    return out


def _octet(tree) -> bool:
    """Whether a piece of a pattern is two hexadecimal digits with a colon or a dash before or after them: two of it in a row hold two such signs with the digits between."""
    if len(tree) == 1 and tree[0][0] is parser.SUBPATTERN:
        return _octet(tree[0][1][3])
    if len(tree) != 2:
        return False
    kinds = []
    for op, arg in tree:
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[:2] == (2, 2) and len(arg[2]) == 1 and (chars := _characters(*arg[2][0])):
            kinds.append("digits" if chars <= _HEX else "")
        else:
            kinds.append("sign" if (chars := _characters(op, arg)) and chars <= frozenset(":-") else "")
    return sorted(kinds) == ["digits", "sign"]


#: Least characters of a word, and most words, that are looked for before a pattern is.
LEAST_WORD, MOST_WORDS = 3, 24


def _worded(tree) -> frozenset[str] | None:
    """Words of which whatever a parsed pattern matches holds one, in lower case; of several such sets the one whose shortest word is the longest."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg).lower()
            continue
        if len(run) >= LEAST_WORD:
            found.append(frozenset({run}))
        run = ""
        inner = None
        if op is parser.SUBPATTERN:
            inner = _worded(arg[3])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] >= 1:
            inner = _worded(arg[2])
        elif op is parser.BRANCH:
            each = [_worded(b) for b in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        if inner and len(inner) <= MOST_WORDS:
            found.append(inner)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


@cache
def words(detector: Detector) -> tuple[str, ...]:
    """Words of which a text that the detector matches holds one, in lower case; none if there are no such words, or case is not that of ASCII."""
    pattern = REWRITTEN.get(detector.id, detector.pattern)
    if not pattern.isascii():
        return ()
    try:
        return tuple(sorted(_worded(parser.parse(pattern, re.ASCII)) or ()))
    except re.error:
        return ()


@cache
def needs(detector: Detector) -> set[str]:
    """Properties without which a text cannot hold a match; what Python cannot parse needs none."""
    pattern = REWRITTEN.get(detector.id, detector.pattern)
    try:
        return _needed(parser.parse(pattern, re.ASCII))
    except re.error:
        return set()
