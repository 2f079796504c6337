"""Which elements of a page its style sheets show: the cascade of ``display`` and ``visibility``.

Selectors are chains of compounds (a tag, ``*``, classes, an id, attributes)
with descendant and child combinators. All compounds of all selectors are
numbered, those of a selector in a row, selectors by specificity and then by
order. The state of an element are two sets of numbers, as bits: the compounds
up to which a selector is matched at the element itself, and at it or any
element that is open around it. Entering an element shifts its parent's sets by
one and keeps what its tag, classes, id and attributes match, so the work does
not depend on the depth, and the highest number among the last compounds that
match names the rule that wins. Results are kept by what an element and its
parent are.

Not matched are selectors with pseudo-classes, sibling combinators, or what
cannot be parsed; rules within conditions that do not hold on every screen do
not count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKENS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[{};]|[^{};\"'/]++|/", re.S)
#: At-rules whose rules hold on a screen of any size.
_APPLIES = re.compile(r"@media(?:\s+(?:only\s+)?(?:screen|all))?(?:\s*,.*)?\Z|@media\b.*,\s*(?:only\s+)?(?:screen|all)\s*(?:,.*)?\Z|@layer\b.*\Z", re.I | re.S)
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)((?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?:;|\Z)", re.I)
#: What ``display`` may say, but for ``none``.
_SHOWN = frozenset("block inline inline-block flex inline-flex grid inline-grid flow flow-root contents table inline-table table-row table-cell table-caption table-column table-column-group table-header-group table-footer-group table-row-group list-item ruby run-in math initial inherit unset".split())
_SEEN = {"hidden": "hidden", "collapse": "hidden", "visible": "visible", "initial": "visible", "inherit": "inherit", "unset": "inherit"}
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_COMPOUND = re.compile(rf"(?:\*|{_NAME})?(?:[.#]{_NAME}|\[\s*{_NAME}\s*(?:[~|^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*[is]?\s*)?\])*")
_PIECE = re.compile(rf"\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*([is])?\s*)?\]|([.#]?)({_NAME}|\*)")


def applies(media: str) -> bool:
    """Whether a ``media`` attribute holds on every screen."""
    return not media.strip() or bool(_APPLIES.match(f"@media {media.strip()}"))


def declared(body: str) -> dict[str, tuple[str, bool]]:
    """What declarations say of ``display`` (``none`` or ``shown``) and ``visibility``, and whether that is important; later ones count, but for important ones before. Values that are not known are as if not there."""
    found: dict[str, tuple[str, bool]] = {}
    for name, first, rest, important in _DECLARED.findall(body):
        name, values = name.lower(), [first.lower(), *rest.lower().split()]
        if name == "display":
            value = "none" if values == ["none"] else "shown" if all(v in _SHOWN for v in values) else ""
        else:
            value = _SEEN.get(values[0], "") if len(values) == 1 else ""
        if value and (important or not found.get(name, ("", False))[1]):
            found[name] = (value, bool(important))
    return found


def rules(sheet: str) -> list[tuple[str, dict[str, tuple[str, bool]]]]:
    """(selectors, what they are declared) of the rules that hold on every screen, in order, if they tell whether something is shown."""
    found = []
    outer: list[tuple[str, list[str]]] = []  # of each open block: what stands before it, and its own declarations
    part: list[str] = []
    skipped = 0  # blocks that are open inside of one that does not count, and that one
    for token in _TOKENS.findall(sheet):
        if token == "{":
            head, part = "".join(part).strip(), []
            if skipped or (outer and outer[-1][0][:1] != "@") or (head[:1] == "@" and not _APPLIES.match(head)):
                skipped += 1
            else:
                outer.append((head, []))
        elif token == "}":
            if skipped:
                skipped -= 1
            elif outer:
                head, own = outer.pop()
                said = declared("".join([*own, "".join(part)])) if head[:1] != "@" else {}
                if said:
                    found.append((head, said))
            part = []
        elif token == ";":
            if outer and not skipped:
                outer[-1][1].append("".join([*part, ";"]))
            part = []
        elif token[:2] != "/*":
            part.append(token)
    return found


@dataclass(frozen=True)
class Compound:
    """What one element has to be: its keys (a tag, ``.class``, ``#id``), attributes (name, operator, value), and whether its parent has to match what comes before."""

    keys: frozenset[str]
    attributes: tuple[tuple[str, str, str], ...]
    child: bool


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def parsed(selector: str) -> tuple[list[Compound], tuple[int, int, int]] | None:
    """The compounds of a selector, from the outermost, and its specificity; None if it has something else in it."""
    chain, weight, at, child = [], [0, 0, 0], 0, False
    selector = selector.strip()
    while at < len(selector):
        found = _COMPOUND.match(selector, at)
        if not found or found.end() == at:
            return None
        keys, attributes = set(), []
        for name, op, value, flag, sign, key in _PIECE.findall(found[0]):
            if name:
                value = value[1:-1] if value[:1] in ("'", '"') else value
                attributes.append((name.lower(), op, value))
                weight[1] += 1
                if flag == "i":
                    return None
            elif sign:
                keys.add(sign + _plain(key).lower())
                weight[0 if sign == "#" else 1] += 1
            elif key != "*":
                keys.add(key.lower())
                weight[2] += 1
        chain.append(Compound(frozenset(keys), tuple(attributes), child))
        between = re.compile(r"\s*(>?)\s*").match(selector, found.end())
        at, child = between.end(), bool(between[1])
        if at < len(selector) and found.end() == at:
            return None
    return (chain, (weight[0], weight[1], weight[2])) if chain and not child else None


def _holds(attribute: tuple[str, str, str], own: dict[str, str]) -> bool:
    name, op, value = attribute
    if name not in own:
        return False
    has = own[name]
    tests = {
        "": lambda: True, "=": lambda: has == value, "~=": lambda: value in has.split(), "|=": lambda: has == value or has.startswith(value + "-"), "^=": lambda: bool(value) and has.startswith(value),
        "$=": lambda: bool(value) and has.endswith(value), "*=": lambda: bool(value) and value in has,
    }
    return tests[op]()


class Sheet:
    """The rules of a page's style sheets. A state is a pair of sets of numbers, as bits: matched at an element, and at it or around it."""

    start = (0, 0)

    def __init__(self, text: str):
        numbered: dict[tuple, dict[str, tuple[str, bool]]] = {}
        for order, (heads, said) in enumerate(rules(text) if text.strip() else ()):
            for head in heads.split(",") if "(" not in heads and '"' not in heads and "'" not in heads else [heads]:
                if found := parsed(head):
                    chain, weight = tuple(found[0]), found[1]
                    before = numbered.pop((weight, chain), (0, {}))[1]  # the same selector again stands where it stands last
                    kept = {k: v for k, v in before.items() if k not in said or (v[1] and not said[k][1])}
                    numbered[weight, chain] = (order, said | kept)
        self.first = self.children = self.inner = 0
        self.masks: dict[str, int] = {}  # compounds by the key of which an element needs no more
        self.others: dict[str, list[tuple[int, Compound]]] = {}  # those that need more, by one of their keys
        self.effects: dict[int, dict[str, tuple[str, bool]]] = {}
        self.last = {(name, important): 0 for name in ("display", "visibility") for important in (False, True)}
        at = 0
        for (_, chain), (_, said) in sorted(numbered.items(), key=lambda item: (item[0][0], item[1][0])):
            for k, compound in enumerate(chain):
                bit = 1 << at
                self.first |= bit if k == 0 else 0
                self.children |= bit if compound.child else 0
                self.inner |= bit if k and not compound.child else 0
                key = max(compound.keys, key=lambda x: (x[:1] == "#", x[:1] == ".", x), default="*")
                if compound.attributes or len(compound.keys) > 1:
                    self.others.setdefault(key, []).append((bit, compound))
                else:
                    self.masks[key] = self.masks.get(key, 0) | bit
                at += 1
            self.effects[at - 1] = said
            for name, (_, important) in said.items():
                self.last[name, important] |= 1 << (at - 1)
        self.empty = not at
        self._known: dict[tuple, tuple] = {}
        self._same: dict[int, int] = {}

    def entered(self, parent: tuple[int, int], tag: str, own: dict[str, str]) -> tuple[tuple[int, int], str, str]:
        """The state of an element inside of a parent, and what holds for its ``display`` and ``visibility``, empty if nothing does."""
        style = own.get("style")
        inline = declared(style) if style else {}
        if self.empty:
            return self.start, inline.get("display", ("",))[0], inline.get("visibility", ("",))[0]
        keys = (tag, own.get("class", ""), own.get("id", ""))
        attributes = tuple(own.items()) if "*" in self.others or any(k in self.others for k in (tag, f"#{keys[2].lower()}")) or self.others and keys[1] else ()
        known = self._known.get((parent, keys, attributes))
        if known is None:
            known = self._entered(parent, keys, own)
            if len(self._known) < 10_000:
                self._known[parent, keys, attributes] = known
        state, won = known
        out = []
        for name in ("display", "visibility"):
            important, usual = won[name]
            said, strong = inline.get(name, ("", False))
            out.append(said if said and strong else important or said or usual)
        return state, out[0], out[1]

    def _entered(self, parent: tuple[int, int], keys: tuple[str, str, str], own: dict[str, str]) -> tuple[tuple[int, int], dict[str, tuple[str, str]]]:
        names = {keys[0], *(f".{c}" for c in keys[1].lower().split()), f"#{keys[2].lower()}"}
        matching = self.masks.get("*", 0)
        for name in names:
            matching |= self.masks.get(name, 0)
        for name in (*names, "*"):
            for bit, compound in self.others.get(name, ()):
                if compound.keys <= names and all(_holds(a, own) for a in compound.attributes):
                    matching |= bit
        here = matching & (self.first | (parent[1] << 1 & self.inner) | (parent[0] << 1 & self.children))
        around = parent[1] | here
        state = (self._same.setdefault(here, here), parent[1] if around == parent[1] else self._same.setdefault(around, around))
        winner = lambda name, important: self.effects[bits.bit_length() - 1][name][0] if (bits := here & self.last[name, important]) else ""
        return state, {name: (winner(name, True), winner(name, False)) for name in ("display", "visibility")}
