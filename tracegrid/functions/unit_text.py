"""What a unit text says: cleaning, leading step, spelling look-up, name tails.

Plain Python, used by the Arrow function in ``operators.unit_resolution`` (one
memoised call per distinct text and worker) and by the tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Texts that stand for "no unit given", after cleaning and lower-casing.
PLACEHOLDERS = frozenset({"", "-", "--", "none", "n/a", "na", "null", "nil", "nan", "unknown", "?", "."})

_BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
_NUMBER = r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"
_STEP = re.compile(rf"^(?:(?P<num>{_NUMBER})\s*/\s*(?P<den>{_NUMBER})|(?P<one>{_NUMBER}))\s*[*x×]?\s*(?P<rest>\D.*)$")


def clean_unit_text(text: str | None) -> str:
    """Repairs a mis-decoded degree sign, drops stray blanks and enclosing brackets."""
    if text is None:
        return ""
    t = text.replace("Â", "").replace("º", "°").replace("˚", "°").replace("�", "°")
    t = " ".join(t.replace(" ", " ").split())
    while len(t) >= 2 and _BRACKETS.get(t[0]) == t[-1]:
        t = t[1:-1].strip()
    return t


def is_placeholder(text: str | None) -> bool:
    return clean_unit_text(text).lower() in PLACEHOLDERS


def squeeze(name: str | None) -> str:
    """A name without case, blanks and punctuation."""
    return "".join(c for c in (name or "").lower() if c.isalnum())


@dataclass(frozen=True)
class Unit:
    unit: str
    dimension: str
    base_unit: str
    factor: float
    offset: float
    convertible: bool


@dataclass(frozen=True)
class Evidence:
    """``value * scale + shift`` is in ``unit``; ``source`` says where that stood."""

    unit: Unit
    scale: float
    shift: float
    source: str


@dataclass
class UnitBook:
    """Unit definitions, channel rules and quantity limits, ready for look-up."""

    units: list[Unit]
    aliases: dict[str, list[str]]
    rules: dict[str, tuple[str | None, str | None, float, float]] = field(default_factory=dict)
    quantities: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.exact: dict[str, list[Unit]] = {}
        self.folded: dict[str, list[Unit]] = {}
        for u in self.units:
            for s in dict.fromkeys([u.unit, *(self.aliases.get(u.unit) or [])]):
                for book, key in ((self.exact, s), (self.folded, s.lower())):
                    hits = book.setdefault(key, [])
                    if u not in hits:
                        hits.append(u)

    def spelled(self, text: str, dimension: str | None) -> Unit | None | bool:
        """The unit that ``text`` spells; False if undecided between several, None if none."""
        for book, key in ((self.exact, text), (self.folded, text.lower())):
            if hits := book.get(key):
                if len(hits) == 1:
                    return hits[0]
                own = [u for u in hits if u.dimension == dimension]
                return own[0] if len(own) == 1 else False
        return None

    def read(self, text: str | None, dimension: str | None) -> tuple[Unit, float] | None:
        """Unit and step of a unit text; the whole text is looked up before a leading number."""
        t = clean_unit_text(text)
        if not t:
            return None
        hit = self.spelled(t, dimension)
        if hit is not None:
            return (hit, 1.0) if hit else None
        if m := _STEP.match(t):
            step = float(m["one"]) if m["one"] else float(m["num"]) / float(m["den"] or 1) if float(m["den"]) else 0.0
            hit = self.spelled(clean_unit_text(m["rest"]), dimension)
            if hit and step > 0:
                return hit, step
        return None

    def tail(self, name: str | None) -> tuple[str, str] | None:
        """(rest, unit text) of a name that ends in a unit text.

        A bracketed tail or one after the word "in" needs only to spell a unit; a
        bare tail after a blank, ``_``, ``.`` or ``-`` counts only where the rest names a known
        quantity, since abbreviated names end in letters that look like units.
        """
        n = " ".join((name or "").split())
        for close, opening in (("]", "["), (")", "("), ("}", "{"), (">", "<")):
            if n.endswith(close) and (at := n.rfind(opening)) > 0:
                rest = n[:at].strip(" _.-")
                return (rest, n[at + 1 : -1].strip()) if rest and self.known(n[at + 1 : -1]) else None
        if (at := n.lower().find(" in ")) > 0 and self.known(n[at + 4 :]):
            return n[:at].strip(), n[at + 4 :].strip()
        for at in range(1, len(n) - 1):
            if n[at] in "_ .-" and squeeze(n[:at]) in self.quantities and self.known(n[at + 1 :]):
                return n[:at].strip(), n[at + 1 :].strip()
        return None

    def known(self, text: str) -> bool:
        t = clean_unit_text(text)
        if t in self.exact or t.lower() in self.folded:
            return True
        m = _STEP.match(t)
        return bool(m) and (clean_unit_text(m["rest"]).lower() in self.folded)

    def base_name(self, name: str | None) -> str:
        """The name without unit text, case, blanks and punctuation."""
        cut = self.tail(name)
        return squeeze(cut[0] if cut else name)

    def quantity(self, name: str | None) -> str | None:
        rule = self.rules.get((name or "").strip().lower())
        if rule and rule[0]:
            return rule[0]
        hit = self.quantities.get(self.base_name(name))
        return hit[0] if hit else None

    def dimension_of(self, quantity: str | None) -> str | None:
        hit = self.quantities.get(squeeze(quantity)) if quantity else None
        return hit[1] if hit else None

    def resolve(self, name: str | None, unit: str | None) -> tuple[str | None, Evidence | None]:
        """Quantity and unit evidence: the rule's unit, else the unit text, else the name's tail."""
        quantity = self.quantity(name)
        dimension = self.dimension_of(quantity)
        rule = self.rules.get((name or "").strip().lower())
        if rule and not is_placeholder(rule[1]):
            if hit := self.read(rule[1], dimension):
                u, step = hit
                return quantity, Evidence(u, rule[2] * step, rule[3] * step, "rule")
        if not is_placeholder(unit):
            hit = self.read(unit, dimension)
            return quantity, Evidence(hit[0], hit[1], 0.0, "unit") if hit else None
        if cut := self.tail(name):
            if hit := self.read(cut[1], dimension):
                return quantity, Evidence(hit[0], hit[1], 0.0, "name")
        return quantity, None


def differs_from_base(e: Evidence | None) -> bool:
    """Whether the numbers are recorded in another unit than the base unit, or scaled."""
    if e is None or not e.unit.convertible:
        return False
    return e.unit.unit != e.unit.base_unit or e.scale != 1.0 or e.shift != 0.0
