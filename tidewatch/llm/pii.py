"""Personal data, plain and disguised, with offsets into the original text.

Disguises are undone by a chain of transducers: each rewrites a text and remembers
which source characters every rewritten stretch came from.  Identifiers are then
detected in the rewritten text and their spans mapped back through the chain.  A text
without disguises passes through unchanged and is searched once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

# ---- detection -----------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; from each at sign outwards, so long runs cost nothing."""
    done = 0
    for found in _DOMAIN.finditer(text):
        at = start = found.start()
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at:
            yield start, found.end()
            done = found.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by kind and start; matches that fail their check are dropped."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


# ---- transducers ---------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip(
    "аеорсхуіјѕԁһԛԝАВЕКМНОРСТХІЈЅ" "αορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcxyijsdhqwABEKMHOPCTXIJS" "aopviktuABEZHIKMNOPTYX", strict=True,
)) | dict.fromkeys("。｡۔", ".")  # and full stops


def _homoglyphs() -> dict[int, str]:
    """Characters that stand for one ASCII character: compatibility forms, digits of all
    scripts, and the look-alike letters."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for code in (*range(0xA0, 0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x10480, 0x1FBFA)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~":
            table.setdefault(code, plain)
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table.setdefault(code, str(int(digit)))
    return table


_PLAIN = _homoglyphs()


def _ranges(codes: list[int]) -> str:
    """A character class of the codes, neighbours joined."""
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out) + "]"


_HOMOGLYPH = re.compile(_ranges(list(_PLAIN)))
_INVISIBLE = re.compile("[­​-‏⁠﻿]+")

# Digit names in the corpus's languages, in order from nought.
_DIGIT_NAMES = [
    ("zero", "oh", "zéro", "cero", "null"), ("one", "un", "une", "uno", "eins"), ("two", "deux", "dos", "zwei"),
    ("three", "trois", "tres", "drei"), ("four", "quatre", "cuatro", "vier"), ("five", "cinq", "cinco", "fünf"),
    ("six", "seis", "sechs"), ("seven", "sept", "siete", "sieben"), ("eight", "huit", "ocho", "acht"),
    ("nine", "neuf", "nueve", "neun"),
]
_DIGIT_OF = {name: str(i) for i, names in enumerate(_DIGIT_NAMES) for name in names}
# How "at", "dot" and "plus" are written out.
_AT, _DOT, _PLUS = ("at", "arobase", "arroba", "klammeraffe"), ("dot", "point", "punto", "punkt"), ("plus", "más")
# Every top-level domain: endings that make "a at b dot c" an address though nothing is bracketed.
_TOP_LEVEL = frozenset(
    line.lower() for line in files(__package__).joinpath("tlds.txt").read_text("ascii").split("\n")[1:] if line
)
# Endings that count after a dot that is no written-out one, too.
_ENDINGS = frozenset("com org net edu gov mil info biz io co uk de fr eu ca au ch nl example test".split())

# Words that stand before or after an "at" in prose, and are no name in "a at b dot c".
_PROSE = frozenset(
    "a all am an and any are arrive arrived arriving back bad be been being best better but down even glance good great he "
    "her here him his home i in is it its just laugh laughed later least less live lived look looked looking looks me meet "
    "meeting met more most my never night nor not now off on once one only or our out over she shop smile so stare stared stay "
    "stayed still stop stopped than that the their them then there these they this those up us was we were what which who "
    "work worked works yell you your".split()
)


def _either(names: tuple[str, ...] | list[str]) -> str:
    """Names in either case, longest first."""
    both = lambda c: c if c.upper() == c.lower() else f"[{c.lower()}{c.upper()}]"
    return "|".join("".join(map(both, n)) for n in sorted(names, key=len, reverse=True))


_NAME = _either([*_DIGIT_OF])
_UNIT = rf"(?:{_NAME}|[0-9]++)"
_BRACKETED_DOT = rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,2}}(?:{_either(_DOT)}|\.)[ \t]{{0,2}}[\])}}>][ \t]{{0,3}}"
_SPELLED = re.compile(
    rf"(?<!\w)(?:(?:{_either(_PLUS)})[ -]{{1,2}})?{_UNIT}"
    rf"(?:(?:[ -]{{1,3}}(?:(?:{_either(_DOT)})[ -]{{1,3}})?|\.|\)[ -]?|{_BRACKETED_DOT}){_UNIT})+(?!\w)"
)
_SPELLED_PART = re.compile(
    rf"(?P<digit>{_NAME})|(?P<number>[0-9]+)|(?P<dot>{_BRACKETED_DOT}|{_either(_DOT)}|\.)|(?P<plus>{_either(_PLUS)})"
)
_SIGN = re.compile(
    rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,2}}(?:(?P<at>{_either(_AT)}|@)|(?P<dot>{_either(_DOT)}|\.))[ \t]{{0,2}}[\])}}>][ \t]{{0,3}}"
    rf"|(?P<coded_at>&#0*64;|&commat;)|(?P<coded_dot>&#0*46;|&period;)"
    rf"|(?<=\w)(?:(?P<bare_at>[ \t]{{1,3}}(?:{_either(_AT)})[ \t]{{1,3}}|_(?:{_either(_AT)})_)"
    rf"|(?P<bare_dot>[ \t]{{1,3}}(?:{_either(_DOT)})[ \t]{{1,3}}|_(?:{_either(_DOT)})_)"
    rf"|(?P<wide_at>[ \t]{{1,3}}@[ \t]{{1,3}}))(?=\w)"
)
_LETTER_DIGIT = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[OoIl]{1,4}(?=[ -]?[0-9]|(?!\w))")


class Rewritten:
    """A text with stretches replaced: (start, end, replacement, tag) in order."""

    def __init__(self, text: str, edits: list[tuple[int, int, str, str]]):
        self.edits = edits
        pieces, at, length = [], 0, 0
        self.new_starts, self.new_ends = [], []  # of the replacements, in the new text
        for start, end, with_, _ in edits:
            pieces += [text[at:start], with_]
            length += start - at
            self.new_starts.append(length)
            length += len(with_)
            self.new_ends.append(length)
            at = end
        pieces.append(text[at:])
        self.text = "".join(pieces)

    def _back(self, place: int, first: bool) -> int:
        """Source place of a character of the new text; of its beginning, or of its end."""
        i = bisect_right(self.new_starts, place) - 1
        if i < 0:
            return place if first else place + 1
        start, end = self.edits[i][:2]
        if self.new_starts[i] <= place < self.new_ends[i]:
            return start if first else end
        shifted = end + place - self.new_ends[i]
        return shifted if first else shifted + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start, True), self._back(end - 1, False)

    def tags(self, start: int, end: int) -> list[tuple[int, str]]:
        """New place and tag of the replacements within a span."""
        at = bisect_right(self.new_ends, start)
        out = []
        while at < len(self.edits) and self.new_starts[at] < end:
            out.append((self.new_starts[at], self.edits[at][3]))
            at += 1
        return out


def invisible(text: str) -> Rewritten:
    """Deletes characters that are not seen."""
    return Rewritten(text, [(*m.span(), "", "") for m in _INVISIBLE.finditer(text)])


def spelled(text: str) -> Rewritten:
    """Runs of digit names, with digits, plus and dots between, become digits.

    Nothing stays between single digits and at dots; beside a longer number one character does.
    """
    edits = []
    for run in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, *run.span()))
        if not any(part["digit"] for part in parts):
            continue
        before = None
        for part in parts:
            if before is not None and (gap := part.start() - before.end()):
                long = any(p["number"] and len(p[0]) > 1 for p in (before, part))
                numbers = before["number"] and part["number"]
                if not (long or numbers) or before["dot"] or part["dot"] or before["plus"]:
                    edits.append((before.end(), part.start(), "", ""))
                elif gap > 1 and not numbers:
                    edits.append((before.end(), part.start(), " ", ""))
            new = part["number"] or _DIGIT_OF.get(part[0].lower()) or ("." if part["dot"] else "+")
            if new != part[0]:
                edits.append((*part.span(), new, "digit"))
            before = part
    for run in _LETTER_DIGIT.finditer(text):
        edits += [(i, i + 1, "0" if text[i] in "Oo" else "1", "digit") for i in range(*run.span())]
    edits.sort()
    return Rewritten(text, [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]])


def signs(text: str) -> Rewritten:
    """Written-out at and dot, bracketed, coded or between words, become signs."""
    return Rewritten(text, [
        (*m.span(), "@" if m.lastgroup.endswith("at") else ".", m.lastgroup) for m in _SIGN.finditer(text)
    ])


def _address(text: str, start: int, end: int, tags: list[tuple[int, str]]) -> int:
    """Where a rewritten address ends, or 0 if it is none.

    "a at b.c" may be ordinary prose: a bare "at" counts only with a written-out dot
    and a top-level domain, of a few if other dots are not written out, and not beside a
    word of prose ("look at me dot it").  The address ends before written-out dots that are prose.
    """
    sign = text.index("@", start)
    names = text[start:sign].lower(), text[sign + 1:text.index(".", sign)].lower()
    if any(place == sign and tag == "bare_at" for place, tag in tags) and not _PROSE.isdisjoint(names):
        return 0
    while True:
        last = text.rindex(".", sign, end)
        ending = text[last + 1:end]
        plain = not any(place == last and tag == "bare_dot" for place, tag in tags)
        bare = any(place == sign and tag == "bare_at" for place, tag in tags)
        dotted = any(sign < place < end and tag in ("dot", "coded_dot", "bare_dot") for place, tag in tags)
        written = sum(sign < place <= last and tag in ("dot", "coded_dot", "bare_dot") for place, tag in tags)
        known = ending.lower() in _ENDINGS or (ending.lower() in _TOP_LEVEL and written == text.count(".", sign, end))
        if (known if bare else plain or known) and (dotted or not bare) and ending.isalpha() and len(ending) > 1:
            return end
        if "." not in text[sign:last]:
            return 0
        end = last


def disguised(text: str) -> list[Span]:
    """Spans found only once the disguises are undone."""
    plain = text.translate(_PLAIN) if _HOMOGLYPH.search(text) else text
    steps: list[Rewritten] = []
    for pattern, transducer in ((_INVISIBLE, invisible), (_SPELLED, spelled), (_SIGN, signs)):
        if pattern.search(plain) or (transducer is spelled and _LETTER_DIGIT.search(plain)):
            steps.append(transducer(plain))
            plain = steps[-1].text
    if plain == text:
        return []
    last = steps[-1] if steps and steps[-1].edits and steps[-1].edits[0][3] not in ("", "digit") else None
    out = []
    for kind, start, end in detect(plain):
        if kind == 0 and last is not None:
            tags = last.tags(start, end)
            if any("bare" in tag for _, tag in tags):
                end = _address(plain, start, end, tags)
                if not end:
                    continue
        for step in reversed(steps):
            start, end = step.source(start, end)
        out.append((kind, start, end))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that undoing disguises adds: no added span touches a base
    span of its kind."""
    base = detect(text)
    added: list[Span] = []
    for kind, start, end in sorted(disguised(text)):
        at = bisect_right(base, (kind, end - 1, len(text)))  # the last base span that begins before the end
        near = (*base[max(0, at - 1):at], *added[-1:])
        if not any(k == kind and s < end and e > start for k, s, e in near):
            added.append((kind, start, end))
    return base, added


# ---- the operator ----------------------------------------------------------------


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, base and added, arrays of (kind, start,
    end) by kind and start, in characters, the end exclusive.

    A null text is empty and has no spans; repeated rows are searched each for itself;
    an empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = "array<struct<kind:string,start:bigint,end:bigint>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found]
        for batch in batches:
            both = [spans(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), *(pa.array([named(pair[i]) for pair in both], shape) for i in (0, 1))],
                ["kept", "base", "added"],
            )

    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL(f"base {found}, added {found}").fields])
    return rows.mapInArrow(run, schema).select("kept.*", "base", "added")


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``."""
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    rank = "array_position(array('email', 'ip', 'card', 'phone'), x.kind)"
    every = (
        f"transform(array_sort(transform(concat(base, added), x -> struct({rank} AS rank, x.start AS start, x.kind AS kind,"
        " x.end AS end))), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))"
    )
    counts = {f"n_{k}": F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)") for k in KINDS}
    return found.withColumns({
        **counts, "base_sha256": F.sha2(joined("base"), 256), "spans": joined(every),
        "n_added": F.size("added").cast("long"),
    }).drop("base", "added")
