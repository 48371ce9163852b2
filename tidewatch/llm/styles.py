"""What the style elements of a page say about showing elements: display and visibility.

Selectors of one element are read (names, classes, ids and what is joined of them, in
lists); such that look at other elements, at attributes or states match nothing.  Blocks
for other media than the screen and under conditions do not apply.
"""

from __future__ import annotations

import re
from collections import Counter

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_MEDIA = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen))?\s*\Z", re.I)
_APPLIES = re.compile(r"@(?:layer\b[^;]*|media\s*(?:(?:only\s+)?(?:all|screen))?\s*)\Z", re.I)
_COMPOUND = re.compile(r"\s*(?:([A-Za-z][\w-]*)|\*)?((?:[.#][\w-]+)*)\s*\Z")
_SETS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_SEEN = frozenset(["hidden", "collapse", "visible", "initial"])


def on_screen(media: str) -> bool:
    """Whether a style element for these media applies."""
    return any(_MEDIA.match(m) for m in media.split(","))


def rules(sheet: str):
    """Selector and declarations of the rules that apply, in order; as far as they can be read."""
    begin, heads, applies = 0, [], [True]
    sheet = _COMMENT.sub(" ", sheet)
    for sign in _BRACE.finditer(sheet):
        before, begin = sheet[begin:sign.start()], sign.end()
        if sign[0] == "{":
            head = before.rpartition(";")[2].strip()
            heads.append(None if head.startswith("@") else head)
            if heads[-1] is None:
                applies.append(applies[-1] and bool(_APPLIES.match(head)))
        elif heads:
            head = heads.pop()
            if head is None:
                applies.pop()
            elif applies[-1]:
                yield head, before


class Sheet:
    """The rules of a page that show or hide, found by an id, class or name of an element."""

    def __init__(self, texts: list[str]):
        found: dict[tuple, tuple[tuple, str]] = {}
        for order, (heads, sets) in enumerate(rule for text in texts for rule in rules(text)):
            said = _SETS.findall(sets)
            for head in heads.split(",") if said else ():
                compound = _COMPOUND.match(head)
                if not compound or not head.strip():
                    continue
                parts = re.findall(r"[.#][\w-]+", compound[2])
                name, signs = (compound[1] or "").lower(), frozenset(parts)
                ids = sum(p.startswith("#") for p in parts)
                for what, value, important in said:
                    weight = (bool(important), False, ids, len(parts) - ids, bool(name), order)
                    found[name, signs, what.lower(), bool(important)] = weight, value.lower()
        uses = Counter(sign for _, signs, *_ in found for sign in signs)
        self.rules: dict[str, list[tuple]] = {}
        for (name, signs, what, _), (weight, value) in found.items():
            rarest = min(signs, key=lambda s: (uses[s], s)) if signs else name  # few elements look at the rule
            self.rules.setdefault(rarest, []).append((name, signs, what, weight, value))

    def style(self, name: str, attributes: dict[str, str]) -> str | None:
        """The style of an element with its own one counted in; None if no rule matches it."""
        signs = {f".{c}" for c in attributes.get("class", "").split()}
        if "id" in attributes:
            signs.add(f"#{attributes['id']}")
        best: dict[str, tuple[tuple, str]] = {}
        for key in (*signs, name, ""):
            for element, needed, what, weight, value in self.rules.get(key, ()):
                if element in ("", name) and needed <= signs and (what not in best or best[what][0] < weight):
                    best[what] = weight, value
        if not best:
            return None
        for order, (what, value, important) in enumerate(_SETS.findall(attributes.get("style", ""))):
            weight = (bool(important), True, 0, 0, False, order)
            if what.lower() not in best or best[what.lower()][0] < weight:
                best[what.lower()] = weight, value.lower()
        out = ["display:none"] if best.get("display", ((), ""))[1] == "none" else []
        seen = best.get("visibility", ((), ""))[1]
        return ";".join([*out, f"visibility:{seen}"] if seen in _SEEN else out)
