"""Secret scans with multipart credential linking, in built-in functions only.

Three strong kinds stand by themselves.  Other parts of a credential - access
identifiers, secrets and endpoints in weaker forms - are reported only when their
complement lies in the same scope: parts of one document that begin at most ``reach``
characters apart.  That is an interval join: places are cut into cells of ``reach``
characters, the parts of a cell are condensed to their first and last place, and a
weak part looks at its own and the two neighbouring cells by equality.  So a document
full of parts gives rows in proportion to its parts, never pairs.

Places of matches come from the texts between them: a text split at a pattern and the
matches of the pattern, with their lengths added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

_KEYWORDS = "password|passwd|secret|token|api_?key"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"

# Fixed patterns of the strong kinds, in the order that spans of one place are listed in.
# A match of assign counts if its value has 12 characters or more.
ASSIGN = f"(?i:{_KEYWORDS}){_SET}({_VALUE}+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")

# Parts that can be linked.  One search finds them all, so they never overlap.
_WEAK_KEYWORDS = f"{_KEYWORDS}|pwd|passphrase|private_?key|credential"
_NAMES = "access_?key_?id|client_?id|user_?name|user_?id|user|account|login"
_HOSTS = "host|endpoint|server"
_SCHEMES = "https?|postgresql|postgres|mysql|mongodb|redis|amqp|s?ftp"
_BARE = r"""[\x20\t\n"'=:,;(][A-Za-z0-9+/_-]{20,}"""
PARTS = "|".join([
    f"(?i:{_WEAK_KEYWORDS}){_SET}{_VALUE}{{6,}}", f"(?i:{_NAMES}){_SET}[A-Za-z0-9_.@+-]{{3,}}",
    f"(?i:{_HOSTS}){_SET}[A-Za-z0-9][A-Za-z0-9.:/-]{{3,}}", f"(?:{_SCHEMES})://[A-Za-z0-9.-]+", _BARE,
    "A[KS]IA[A-Z0-9]{6,}", HEX,
])
# What a part is, by the first pattern that it has: role, and whether it is strong.
ROLES = [
    (f"^(?i:{_KEYWORDS}){_SET}{_VALUE}{{12,}}$", "secret", True),
    (f"^(?i:{_WEAK_KEYWORDS}){_SET}", "secret", False),
    (f"^(?i:{_NAMES}){_SET}", "id", False),
    (f"^(?i:{_HOSTS}){_SET}", "endpoint", False),
    ("://", "endpoint", False),
    (r"^[^A-Za-z0-9]?AKIA[A-Z0-9]{14,}$", "id", True),
    (r"^[^A-Za-z0-9]?A[KS]IA[A-Z0-9]{6,}$", "id", False),
    (r"^[^A-Za-z0-9]?[0-9a-f]{16,}$", "secret", True),
]

_CHUNK = 512  # matches whose lengths are added up in one go
_NONE = "CAST(array() AS array<struct<start: bigint, end: bigint>>)"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _places(text: str, pattern: str) -> str:
    """SQL for the array (start, end) of a pattern's matches, in code points.

    Lengths are added up in chunks: an array that grows match by match would be copied
    each time, which a text with a million matches could not afford.
    """
    steps = (
        f"zip_with(slice(split({text}, {pattern}, -1), 1, size(regexp_extract_all({text}, {pattern}, 0))),"
        f" regexp_extract_all({text}, {pattern}, 0),"
        " (gap, hit) -> named_struct('gap', CAST(length(gap) AS BIGINT), 'size', CAST(length(hit) AS BIGINT)))"
    )
    chunks = (
        f"transform(array({steps}), s -> transform(sequence(0, (size(s) - 1) div {_CHUNK}),"
        f" c -> slice(s, c * {_CHUNK} + 1, {_CHUNK})))[0]"
    )
    starts = (
        "aggregate(k, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, c) -> named_struct('at',"
        " a.at + aggregate(c, 0L, (n, x) -> n + x.gap + x.size), 'out', array_append(a.out, a.at)), a -> a.out)"
    )
    walk = (
        f"aggregate(c, named_struct('at', at, 'out', {_NONE}), (a, x) -> named_struct('at', a.at + x.gap + x.size, 'out',"
        " array_append(a.out, named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.size))), a -> a.out)"
    )
    return f"transform(array({chunks}), k -> flatten(zip_with(k, {starts}, (c, at) -> {walk})))[0]"


def _found(text: str, pattern: str) -> Column:
    """Matches of a pattern: start, end and what matched; an empty array without any."""
    place = _literal(pattern)
    hits = (
        f"zip_with({_places(text, place)}, regexp_extract_all({text}, {place}, 0),"
        " (p, hit) -> named_struct('start', p.start, 'end', p.end, 'hit', hit))"
    )
    empty = "CAST(array() AS array<struct<start: bigint, end: bigint, hit: string>>)"
    return F.expr(f"CASE WHEN {text} RLIKE {place} THEN {hits} ELSE {empty} END")


def _span(rank: int, items: str) -> str:
    return (
        f"transform({items}, x -> named_struct('start', x.start, 'rank', {rank}, 'kind', '{KINDS[rank]}', 'end', x.end))"
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One pass over the texts: row (a number), kept, base (spans of the strong kinds) and parts."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    value = _literal(f"^(?i:{_KEYWORDS}){_SET}{_VALUE}{{12,}}$")
    hits = rows.select(
        F.monotonically_increasing_id().alias("row"), "kept", _found("text", ASSIGN).alias("assign"),
        _found("text", ACCESS).alias("access"), _found("text", HEX).alias("hex"), _found("text", PARTS).alias("parts"),
    )
    cases = " ".join(
        f"WHEN x.hit RLIKE {_literal(p)} THEN named_struct('role', '{role}', 'strong', {str(strong).lower()})"
        for p, role, strong in ROLES
    )
    mixed = "x.hit RLIKE '[0-9].*[0-9]' AND x.hit RLIKE '[A-Z]' AND x.hit RLIKE '[a-z]'"
    what = f"CASE {cases} WHEN {mixed} THEN named_struct('role', 'secret', 'strong', false) END"
    bare = r"CAST(x.hit RLIKE '^[\x20\t\n\x22\x27=:,;(]' AS INT)".replace("RLIKE '", "RLIKE r'")
    parts = (
        f"transform(parts, x -> named_struct('start', x.start + {bare}, 'end', x.end, 'what', {what}))"
    )
    base = (
        f"array_sort(concat({_span(0, f'filter(assign, x -> x.hit RLIKE {value})')},"
        f" {_span(1, 'access')}, {_span(2, 'hex')}))"
    )
    return hits.select(
        "row", "kept", F.expr(base).alias("base"), F.expr(f"filter({parts}, x -> x.what IS NOT NULL)").alias("parts")
    )


def link(scanned: DataFrame, reach: int) -> DataFrame:
    """row and linked: the spans of weak parts whose complement begins within ``reach``."""
    parts = scanned.select("row", F.explode("parts").alias("p")).select(
        "row", "p.start", "p.end", "p.what.role", "p.what.strong", F.expr(f"p.start div {reach}").alias("cell")
    )
    scopes = parts.where("role <> 'endpoint'").groupBy("row", "role", "cell").agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    asks = parts.where("NOT strong").selectExpr(
        "row", "start", "end", "role AS own", "cell AS home",
        "explode(IF(role = 'endpoint', array('id', 'secret'), array(IF(role = 'id', 'secret', 'id')))) AS role",
    ).selectExpr("*", "explode(array(home - 1, home, home + 1)) AS cell")
    near = (
        f"cell = home OR (cell < home AND start - last <= {reach}) OR (cell > home AND first - start <= {reach})"
    )
    met = asks.join(scopes, ["row", "role", "cell"]).where(near).groupBy("row", "own", "start", "end").agg(
        F.count_if(F.col("role") == "id").alias("ids"), F.count_if(F.col("role") == "secret").alias("secrets")
    )
    rank = " ".join(f"WHEN '{kind}' THEN {KINDS.index(kind)}" for kind in ("id", "secret", "endpoint"))
    reported = met.where("own <> 'endpoint' OR (ids > 0 AND secrets > 0)").selectExpr(
        "row", f"named_struct('start', start, 'rank', CASE own {rank} END, 'kind', own, 'end', end) AS span"
    )
    return reported.groupBy("row").agg(F.collect_list("span").alias("linked"))


def find(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = 300
) -> DataFrame:
    """One row per document: the columns ``keep``, base and spans.

    ``base`` holds the spans of the strong kinds, ``spans`` those and the linked parts,
    both as (start, rank, kind, end) in that order, counted in characters.  A null text
    is empty; empty texts have no spans; repeated rows are scanned each for itself and
    never linked to each other; an empty table gives no rows.  A document's linked
    spans come together in one row, as its text does.
    """
    scanned = materialize(scan(docs, text, keep), "scanned")
    linked = materialize(link(scanned, reach), "linked")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))
    return scanned.join(linked, "row", "left").select("kept.*", "base", spans.alias("spans"))


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces the spans of ``find`` in its column ``text``; overlapping ones become one mark."""
    step = (
        f"CASE WHEN x.start >= a.at THEN named_struct('at', x.end, 'out', concat(a.out, array(substring({text}, "
        f"CAST(a.at + 1 AS INT), CAST(x.start - a.at AS INT)), '{mark}')))"
        " ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END"
    )
    cut = (
        f"aggregate(spans, named_struct('at', 0L, 'out', CAST(array() AS array<string>)), (a, x) -> {step},"
        f" a -> concat(array_join(a.out, ''), substring({text}, CAST(a.at + 1 AS INT))))"
    )
    return found.withColumn(text, F.expr(f"IF(size(spans) = 0, {text}, {cut})"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``."""
    counts = {
        f"n_{kind}": F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT)") for kind in KINDS[:3]
    }
    return found.withColumns({
        **counts, "base_sha256": F.sha2(_joined("base"), 256),
        "n_linked": F.expr("CAST(size(spans) - size(base) AS BIGINT)"), "spans": _joined("spans"),
    }).drop("base")
